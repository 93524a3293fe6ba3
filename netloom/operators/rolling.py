"""Totals over trailing days, from prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from netloom.core.columns import address, day_of, micros
from netloom.core.deliveries import first_deliveries


def daily_bytes(r_host: DataFrame) -> DataFrame:
    """day (epoch day), ip, internal, bytes: per-record rows, second deliveries once, rows without ts left out, null bytes 0."""
    rows = r_host.select("ts", "ip", "internal", "bytes", "arrival_seq", "arrived")
    return first_deliveries(rows).where(F.col("ts").isNotNull()).select(
        day_of(micros(F.col("ts"))).alias("day"), address(F.col("ip")).alias("ip"), "internal",
        F.coalesce(F.col("bytes").cast("long"), F.lit(0).cast("long")).alias("bytes"),
    )


def table_days(r_host: DataFrame) -> tuple[int, int] | None:
    """First and last epoch day of the rows that have a ts; None if there is none."""
    day = day_of(micros(F.col("ts")))
    first, last = r_host.agg(F.min(day), F.max(day)).first()
    return None if first is None else (first, last)


def trailing_totals(active: DataFrame, entity: str, bounds: tuple[int, int] | None, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing totals and averages for every entity and day.

    active: entity, day (epoch day), bytes; any number of rows per entity and day.  bounds: first and last day of the
    result (None: no rows).  Result: entity, day, bytes, and for each n totaln and avgn (total / n; a day without activity
    counts as 0, as do the days before the first).  Each entity has a row for every day, with or without activity.  Null
    entities and days and days outside bounds are left out, null bytes are 0, no rows give no rows.

    Rows are added up per (entity, day) before the shuffle, so an entity brings at most one row per day to its window,
    however many rows it holds.
    """
    first, last = bounds or (0, -1)
    per = (
        active.where(F.col(entity).isNotNull() & F.col("day").between(first, last))
        .groupBy(entity, "day")
        .agg(F.sum(F.coalesce(F.col("bytes"), F.lit(0))).alias("bytes"))
    )
    w = Window.partitionBy(entity).orderBy("day")
    # Prefix sums at active days, each valid until the next active day; before an entity's first one the prefix is 0.
    spans = (
        per.withColumn("prefix", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("until", F.coalesce(F.lead("day").over(w) - 1, F.lit(last)))
        .withColumn("since", F.when(F.lag("day").over(w).isNull(), F.lit(first)).otherwise(F.col("day")))
    )
    out = spans.select(entity, F.explode(F.sequence("since", "until")).alias("at"), "day", "bytes", "prefix").select(
        entity, F.col("at").alias("day"),
        F.when(F.col("at") == F.col("day"), F.col("bytes")).otherwise(F.lit(0)).alias("bytes"),
        F.when(F.col("at") >= F.col("day"), F.col("prefix")).otherwise(F.lit(0)).alias("prefix"),
    )
    for n in days:
        out = out.withColumn(f"total{n}", F.col("prefix") - F.coalesce(F.lag("prefix", n).over(w), F.lit(0)))
    return out.select(entity, "day", "bytes", *[c for n in days for c in (f"total{n}", (F.col(f"total{n}") / n).alias(f"avg{n}"))])


def rolling_hosts(r_host: DataFrame, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """trailing_totals for every address of r_host, both roles together, over the days of the table."""
    return trailing_totals(daily_bytes(r_host), "ip", table_days(r_host), days)


def rising_hosts(r_host: DataFrame, short: int = 7, long: int = 30, factor: int = 3) -> DataFrame:
    """ip, day of internal addresses whose short average is above zero and at least factor times the long one.

    Days run from the table's long-th day to its last, with or without a row of the address; the table's days are those of
    all its rows that have a ts.
    """
    bounds = table_days(r_host)
    out = trailing_totals(daily_bytes(r_host).where("internal"), "ip", bounds, (short, long))
    enough = F.col(f"total{short}") * long >= F.col(f"total{long}") * (factor * short)
    return out.where((F.col("day") >= (bounds or (0,))[0] + long - 1) & (F.col(f"total{short}") > 0) & enough).select(
        "ip", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("day")
    )
