"""Which range, network or list entry an address falls into."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netloom.functions.net import address_key

#: Hex digits of the blocks that ranges are laid out in: fine for a range within MOST fine blocks, else coarse.
FINE, COARSE, MOST = {"4": 4, "6": 8}, {"4": 2, "6": 4}, 256


def network_bounds(cidr: str) -> tuple[str, str]:
    """First and last address key of a prefix or a single address."""
    net = ipaddress.ip_network(cidr.strip(), strict=False)
    digits = 8 if net.version == 4 else 32
    return tuple(f"{net.version}{int(a):0{digits}x}" for a in (net[0], net[-1]))


def networks(spark: SparkSession, rows: list[tuple], payload: str) -> DataFrame:
    """lo, hi, ordinal, len and the payload columns of prefixes given as (cidr, *payload), in list order."""
    laid = [(*network_bounds(r[0]), i, ipaddress.ip_network(r[0].strip(), strict=False).prefixlen, *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(laid, f"lo string, hi string, ordinal int, len int, {payload}")


def _digits(size: dict[str, int]) -> Column:
    return F.when(F.col("lo").startswith("4"), size["4"]).otherwise(size["6"])


def _block(key: Column, n: Column) -> Column:
    return F.substring(key, F.lit(1), n + 1)


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def laid_out(ranges: DataFrame) -> DataFrame:
    """ranges once for each block they touch. A wide range is laid in coarse blocks, at most 65,536 of them."""
    fine = _digits(FINE)
    first, last = _number(F.substring(F.col("lo"), F.lit(2), fine)), _number(F.substring(F.col("hi"), F.lit(2), fine))
    sized = ranges.withColumn("n", F.when(last - first < MOST, fine).otherwise(_digits(COARSE)))
    first, last = _number(F.substring(F.col("lo"), F.lit(2), F.col("n"))), _number(F.substring(F.col("hi"), F.lit(2), F.col("n")))
    cells = sized.withColumn("cell", F.explode(F.sequence(first, last)))
    block = F.concat(F.substring("lo", 1, 1), F.lpad(F.lower(F.hex("cell")), 8, "0").substr(F.lit(9) - F.col("n"), F.col("n")))
    return cells.withColumn("block", block).drop("cell", "n")


def containing(addresses: DataFrame, ranges: DataFrame, order: list[Column], payload: list[str]) -> DataFrame:
    """addr and the payload of the range that comes first by order among those that contain it; no row where none does.

    addresses: addr.  ranges: lo, hi (address keys) and payload.  Distinct addresses only are looked up; each meets the
    ranges of its fine and its coarse block, an equi-join whose rest is the comparison of keys.
    """
    keyed = addresses.select("addr").distinct().withColumn("key", address_key(F.col("addr"))).where("key is not null")
    family = F.substring("key", 1, 1)
    size = lambda d: F.when(family == "4", d["4"]).otherwise(d["6"])
    points = keyed.withColumn("block", F.explode(F.array(_block(F.col("key"), size(FINE)), _block(F.col("key"), size(COARSE)))))
    hits = points.join(laid_out(ranges), "block").where((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")))
    best = hits.groupBy("addr").agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *payload)).alias("best"))
    return best.select("addr", *[F.col(f"best.{p}").alias(p) for p in payload])


def longest_prefix(addresses: DataFrame, nets: DataFrame, payload: list[str]) -> DataFrame:
    """The longest prefix an address lies in; of equal ones the first listed."""
    return containing(addresses, nets, [-F.col("len"), F.col("ordinal")], payload)


def first_listed(addresses: DataFrame, nets: DataFrame, payload: list[str]) -> DataFrame:
    """Exact addresses before prefixes, then the first listed, whatever its length."""
    exact = F.when(F.col("lo") == F.col("hi"), 0).otherwise(1)
    return containing(addresses, nets, [exact, F.col("ordinal")], payload)


def asn_of(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """addr, asn, cc, org. ranges: lo, hi, source (0 is preferred), asn, cc, org; of ranges of a source the narrowest (the
    one that starts last)."""
    # Keys are text of equal length: the complement of lo makes the latest start come first.
    return containing(addresses, ranges, [F.col("source"), F.translate("lo", "0123456789abcdef", "fedcba9876543210")], ["asn", "cc", "org"])
