"""Expressions over flow rows. The texts are valid in Spark SQL; keys are given as text so that one definition names the
grouping columns, the shown form and, in the registered checks, the SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

U64 = 18_446_744_073_709_551_615

PORT = "concat(svc_port, '/', CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE CAST(proto AS STRING) END)"
COUNTRY = "CASE WHEN dir = 3 THEN '__internal__' ELSE peer_cc END"
COUNTRY_NAMED = "CASE WHEN dir = 3 THEN '__internal__' WHEN peer_cc = '' THEN '__unknown__' ELSE peer_cc END"
PEER = "CASE WHEN dir = 2 THEN client ELSE server END"
OWN = "CASE WHEN dir = 2 THEN server ELSE client END"
ASN = "concat(peer_asn, chr(9), peer_org)"
SERVICE = f"concat({PORT}, chr(9), app)"


def unsigned_sum(c: Column | str) -> Column:
    """Sum that stops at 2**64 - 1, as decimal(20,0); for columns that may hold more than a signed sum can."""
    return F.least(F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")), F.lit(Decimal(U64)).cast("decimal(20,0)")).cast("decimal(20,0)")


def total(c: str) -> Column:
    """Sum as a long that stops at 2**63 - 1 instead of failing; rows hold at most 2**46 each."""
    return F.coalesce(F.try_sum(c), F.when(F.count(c) > 0, F.lit(2**63 - 1)).otherwise(F.lit(0)))


SUMS = ("bytes", "wire", "pkts", "flows")


def sums() -> list[Column]:
    return [total(c).alias(c) for c in SUMS]
