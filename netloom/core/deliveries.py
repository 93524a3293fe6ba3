"""Records delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_deliveries(df: DataFrame, key: str = "arrival_seq", arrived: str = "arrived") -> DataFrame:
    """One row per key, the one that arrived first.

    Rows without a key can't be told to be repeats and all stay.  A null arrival counts as the latest; of rows that
    arrived together the one with the smallest hash of its columns stays, so the result doesn't depend on partitioning.
    Keys are near unique, so no key can grow hot; rows without a key never enter the shuffle.
    """
    keyed = df.where(F.col(key).isNotNull())
    w = Window.partitionBy(key).orderBy(F.col(arrived).asc_nulls_last(), F.xxhash64(*df.columns))
    first = keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.unionByName(df.where(F.col(key).isNull()))
