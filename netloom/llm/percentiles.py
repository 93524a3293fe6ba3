"""Exact percentiles of very large columns from cumulative frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from netloom.core.columns import address, day_of, micros
from netloom.core.counters import KEYS, rate, reading_steps
from netloom.core.shared import cut

#: Percentiles in thousandths.
POINTS = (500, 900, 950, 990)


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n: the mergeable partial result. Null and NaN values are left out."""
    v = F.col(value).cast("double")
    return rows.where(F.col(value).isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("value")).agg(F.count("*").alias("n"))


def merged_counts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial results of several partitions or days as one of their union."""
    return parts.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, keys: list[str], points: tuple[int, ...] = POINTS) -> DataFrame:
    """keys, n (values), point (thousandths), value: nearest-rank percentiles, without error.

    counts: keys, value, n as from value_counts.  They are range-partitioned by keys and value and written with their
    partition's number; per (keys, partition) totals give each partition's offset, and only the partitions in which a wanted
    rank falls are summed up in order.  A group of any size lies on as many partitions as it needs; equal values are one
    row.  A group without values gives no row.
    """
    by = [*keys, "value"]
    ranged = cut(counts.repartitionByRange(*by).withColumn("pid", F.spark_partition_id()), "ranged")
    w = Window.partitionBy(*keys)
    sizes = (
        ranged.groupBy(*keys, "pid").agg(F.sum("n").alias("size"))
        .withColumn("to", F.sum("size").over(w.orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("size").over(w))
        .withColumn("point", F.explode(F.array(*[F.lit(p) for p in points])))
        .withColumn("rank", F.greatest(F.lit(1), F.expr("(total * point + 999) div 1000")))
        .where("rank > to - size and rank <= to")
        .select(*keys, "pid", F.col("total"), (F.col("to") - F.col("size")).alias("offset"), "point", "rank")
    )
    wanted = sizes.groupBy(*keys, "pid").agg(F.first("offset").alias("offset"), F.first("total").alias("total"), F.collect_list(F.struct("point", "rank")).alias("wanted"))
    inside = Window.partitionBy(*keys, "pid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    run = (
        ranged.join(wanted, [*keys, "pid"])
        .withColumn("upto", F.col("offset") + F.sum("n").over(inside))
        .withColumn("hits", F.filter("wanted", lambda x: (x["rank"] <= F.col("upto")) & (x["rank"] > F.col("upto") - F.col("n"))))
        .where(F.size("hits") > 0)
    )
    return run.select(*keys, F.col("total").alias("n"), F.explode("hits.point").alias("point"), "value")


def interface_rates(ifc: DataFrame) -> DataFrame:
    """exporter, ifindex, day, us, rate: the rates of usable readings, contradicted ones left out."""
    steps = reading_steps(ifc).withColumn("rate", rate()).where(F.col("rate").isNotNull())
    return steps.select(*KEYS, day_of(F.col("us")).alias("day"), "us", "rate")


def period_percentiles(ifc: DataFrame, periods: DataFrame, points: tuple[int, ...] = POINTS) -> tuple[DataFrame, DataFrame]:
    """The distinct periods with an id, and period, n, point, value for each of them that holds a rate.

    periods: exporter, ifindex, from_us, to_us (half-open).  A period is laid out by days and meets the rates on interface
    and day, so neither a hot interface nor a long period gathers in one task; its value counts are the merged counts of its
    days.  Periods with a null bound or interface, or an end not after the start, hold no rate.
    """
    ids = cut(periods.where("exporter is not null and ifindex is not null and to_us > from_us").select(*KEYS, "from_us", "to_us").distinct().withColumn("period", F.monotonically_increasing_id()), "periods")
    laid = ids.withColumn("day", F.explode(F.sequence(day_of(F.col("from_us")), day_of(F.col("to_us") - 1))))
    inside = interface_rates(ifc).join(laid, [*KEYS, "day"]).where("us >= from_us and us < to_us")
    daily = value_counts(inside, ["period", "day"], "rate")
    return ids, percentiles(merged_counts(daily, ["period"]), ["period"], points)


def report_periods(report_iface: DataFrame) -> DataFrame:
    return report_iface.select(
        address(F.col("exporter")).alias("exporter"), F.col("ifindex").cast("long").alias("ifindex"),
        micros(F.col("period_from")).alias("from_us"), micros(F.col("period_to")).alias("to_us"), F.col("in95").cast("double").alias("in95"),
    )


def report_percentiles(ifc: DataFrame, report_iface: DataFrame) -> DataFrame:
    """exporter, ifindex, from_s, to_s, n, p50, p90, p95, p99 of the rates of each reported interface and period."""
    ids, found = period_percentiles(ifc, report_periods(report_iface))
    wide = found.groupBy("period").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("point") == p, F.col("value"))).alias(f"p{p // 10}") for p in POINTS])
    return ids.join(wide, "period").select(*KEYS, *_seconds(), "n", *[f"p{p // 10}" for p in POINTS])


def _seconds() -> list:
    return [(F.col(f"{x}_us") / 1_000_000).cast("long").alias(f"{x}_s") for x in ("from", "to")]


def misstated_p95(ifc: DataFrame, report_iface: DataFrame, off: float = 0.1) -> DataFrame:
    """exporter, ifindex, from_s, to_s: periods with a stated in95 that differs by more than off from the true one.

    A period without rates has no percentile to differ from; rows without in95 are left out; repeated rows count once.
    """
    stated = report_periods(report_iface).where(F.col("in95").isNotNull())
    ids, found = period_percentiles(ifc, stated, (950,))
    true = ids.join(found.select("period", "value"), "period").drop("period")
    wrong = stated.join(true, [*KEYS, "from_us", "to_us"]).where(F.abs(F.col("in95") - F.col("value")) > off * F.col("value"))
    return wrong.select(*KEYS, *_seconds()).distinct()
