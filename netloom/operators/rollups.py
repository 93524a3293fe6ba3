"""Summaries of flow rows, as partial rows that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions.flow import ASN, COUNTRY, SERVICE, SUMS
from netloom.plans.tables import BOTH, DEVICE, IN, OUT

#: A counter above this wrapped below zero once and counts as nothing.
WRAPPED = 1 << 62
#: Dimensions of the hourly summary, and the rows that have one.
DIMENSIONS = {
    "app": ("app", "true"), "port": (SERVICE, "true"), "country": (COUNTRY, "true"), "proto": ("CAST(proto AS STRING)", "true"),
    "dir": ("CAST(dir AS STRING)", "true"), "exporter": ("exporter", "true"), "segment": ("segment", "true"), "encap": ("CAST(encap AS STRING)", "true"),
    "asn": (ASN, "peer_asn <> 0"),
}


def guarded(c: str) -> Column:
    return F.sum(F.when(F.col(c) > WRAPPED, F.lit(0)).otherwise(F.col(c))).alias(c)


def _sums() -> list[Column]:
    return [guarded(c) for c in SUMS]


def hour() -> Column:
    return F.date_trunc("hour", F.col("ts"))


def r_ts(flows: DataFrame) -> DataFrame:
    """ts (minute), app and sums of the rows that are not duplicates."""
    return flows.where("not dup").groupBy("ts", "app").agg(*_sums())


def r_host(flows: DataFrame) -> DataFrame:
    """ts (hour), ip, role (1 client, 2 server), internal and sums: each row counts for both its ends, in one pass."""
    ends = F.array(
        F.struct(F.col("client").alias("ip"), F.lit(1).cast("short").alias("role"), F.col("cli_int").alias("internal")),
        F.struct(F.col("server").alias("ip"), F.lit(2).cast("short").alias("role"), F.col("srv_int").alias("internal")),
    )
    rows = flows.where("not dup").select(hour().alias("ts"), F.explode(ends).alias("e"), *SUMS)
    return rows.groupBy("ts", F.col("e.ip").alias("ip"), F.col("e.role").alias("role"), F.col("e.internal").alias("internal")).agg(*_sums())


def _dims() -> Column:
    each = [F.struct(F.lit(d).alias("dim"), F.expr(v).alias("val"), F.expr(ok).alias("ok")) for d, (v, ok) in DIMENSIONS.items()]
    return F.explode(F.filter(F.array(*each), lambda x: x["ok"])).alias("d")


def r_dim(flows: DataFrame) -> DataFrame:
    """ts (hour), dim, val and sums; the AS dimension only where it is known."""
    rows = flows.where("not dup").select(hour().alias("ts"), _dims(), *SUMS)
    return rows.groupBy("ts", F.col("d.dim").alias("dim"), F.col("d.val").alias("val")).agg(*_sums())


def observed(flows: DataFrame, obs_if: str = "obs_if") -> DataFrame:
    """The obsif and obsunk rows of r_dim: all rows, duplicates too, under the interface they were sampled on."""
    known = F.col(obs_if) != 0
    return flows.groupBy(
        hour().alias("ts"), F.when(known, "obsif").otherwise("obsunk").alias("dim"),
        F.when(known, F.concat_ws("/", "exporter", obs_if)).otherwise(F.col("exporter")).alias("val"),
    ).agg(*_sums())


def _views() -> Column:
    """The device, the interface a row came in through and the one it went out through, each once."""
    views = F.array(
        F.struct(F.col("exporter").alias("f"), F.lit(DEVICE).alias("s"), F.lit(True).alias("ok")),
        F.struct(F.concat_ws("/", "exporter", "in_if").alias("f"), F.when(F.col("in_if") == F.col("out_if"), BOTH).otherwise(IN).alias("s"), (F.col("in_if") != 0).alias("ok")),
        F.struct(F.concat_ws("/", "exporter", "out_if").alias("f"), F.lit(OUT).alias("s"), ((F.col("out_if") != 0) & (F.col("out_if") != F.col("in_if"))).alias("ok")),
    )
    return F.explode(F.filter(views, lambda x: x["ok"])).alias("v")


def r_ts_if(flows: DataFrame) -> DataFrame:
    """ts (five minutes), iface, side, app and sums; a device's duplicates of others' traffic are its own and count."""
    five = F.timestamp_seconds(F.unix_seconds("ts") - F.pmod(F.unix_seconds("ts"), F.lit(300)))
    rows = flows.select(five.alias("ts"), _views(), "app", *SUMS)
    return rows.groupBy("ts", F.col("v.f").alias("iface"), F.col("v.s").alias("side"), "app").agg(*_sums())


def r_dim_if(flows: DataFrame) -> DataFrame:
    """ts (hour), iface, side, dim, val and sums."""
    rows = flows.select("*", _views()).select(hour().alias("ts"), "v", _dims(), *SUMS)
    return rows.groupBy("ts", F.col("v.f").alias("iface"), F.col("v.s").alias("side"), F.col("d.dim").alias("dim"), F.col("d.val").alias("val")).agg(*_sums())


ALL = {"r_ts": r_ts, "r_host": r_host, "r_dim": r_dim, "r_ts_if": r_ts_if, "r_dim_if": r_dim_if}
