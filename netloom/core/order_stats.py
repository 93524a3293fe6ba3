"""Exact medians of large groups without sorting a group in one task.

A quantile sketch brackets the median between two values that hold a few per cent of the group; the values below the bracket
are counted, those inside it met as (value, count) and only they are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bracketing quantiles, and the sketch's accuracy: a rank error of 1 / ACCURACY, far inside the bracket.
BELOW, ABOVE, ACCURACY = 0.48, 0.52, 1_000


def bracket(value: Column) -> Column:
    """Aggregate: [low, high] around the median of the non-null values."""
    return F.percentile_approx(value, [BELOW, ABOVE], ACCURACY)


def bracketed_medians(rows: DataFrame, keys: list[str], value: str, ends: str, out: str = "median") -> DataFrame:
    """keys and the exact median of value (the mean of the middle two for an even number).

    rows: keys, value and ends, the group's bracket, on every row; rows without value count for nothing and groups without a
    value give no row.  Counts are taken on the map side; a group's ordered part is its distinct values inside the bracket,
    about a twenty-fifth of them.
    """
    v, low, high = F.col(value), F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    # Below the bracket all values count as one, above it as another.
    place = F.when(v < low, F.lit(float("-inf"))).when(v > high, F.lit(float("inf"))).otherwise(v)
    counts = rows.where(v.isNotNull()).groupBy(*keys, place.alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.withColumn("_all", F.sum("_n").over(w))
        .withColumn("_c", F.sum("_n").over(upto))
        .withColumn("_lo", F.expr("(_all + 1) div 2"))
        .withColumn("_hi", F.expr("_all div 2 + 1"))
    )
    at = lambda r: F.max(F.when((F.col(r) > F.col("_c") - F.col("_n")) & (F.col(r) <= F.col("_c")), F.col("_v")))
    return ranked.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias(out))
