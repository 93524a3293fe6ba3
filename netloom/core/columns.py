"""Column expressions used everywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\r\n"


def address(c: Column) -> Column:
    """Plain form of an address: no outer blanks, lower case, ``::ffff:a.b.c.d`` as ``a.b.c.d``; null and '' give null."""
    a = F.lower(F.btrim(c, F.lit(BLANKS)))
    plain = F.when(a.startswith("::ffff:") & a.contains("."), F.substring(a, 8, 64)).otherwise(a)
    return F.when(F.length(a) > 0, plain)


def as_timestamp(c: Column) -> Column:
    """Timestamps with and without zone alike; the session's zone is UTC."""
    return c.cast("timestamp")


def micros(c: Column) -> Column:
    return F.unix_micros(as_timestamp(c))


def day_of(c: Column) -> Column:
    """Epoch day of epoch microseconds."""
    return F.floor(c / F.lit(86_400_000_000)).cast("long")


def floor_div(c: Column, by: int) -> Column:
    """Floor of a long divided by a positive whole number, exact below 2**53."""
    return ((c - F.pmod(c, F.lit(by))) / F.lit(by)).cast("long")
