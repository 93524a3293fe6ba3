"""Readings of cumulative counters per interface, in time order, with no interface bound to one task.

A window over one interface would put all of its rows into one task.  Here the time axis is cut into chunks, windows run
per (interface, chunk), and what a chunk must know of its neighbours travels in a table with one row per (interface,
chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.core.columns import address, floor_div, micros
from netloom.core.shared import cut, laid_by

HOUR_US = 3_600_000_000
CHUNK_US = 6 * HOUR_US
KEYS = ["exporter", "ifindex"]
CELL = [*KEYS, "chunk"]
#: Counter value that stands for "speed unknown" in a 32-bit gauge, beside 0 and null.
UNKNOWN_SPEEDS = [0, 4_294_967_295]


def usable_readings(ifc: DataFrame, skew_us: int = 48 * HOUR_US, chunk_us: int = CHUNK_US) -> DataFrame:
    """exporter, ifindex, chunk, us, in_oct: one row per usable reading, laid by CELL.

    Rows without exporter, ifindex, ts, in_oct or arrived, and rows whose ts is more than skew_us away from arrived, are
    no readings.  Rows equal in address, ifindex and ts are one reading; the one that arrived first counts (then the
    lower counter).
    """
    rows = ifc.select(
        address(F.col("exporter")).alias("exporter"), F.col("ifindex").cast("long").alias("ifindex"),
        micros(F.col("ts")).alias("us"), F.col("in_oct").cast("long").alias("in_oct"), micros(F.col("arrived")).alias("arrived_us"),
    ).where(
        F.col("exporter").isNotNull() & F.col("ifindex").isNotNull() & F.col("us").isNotNull() & F.col("in_oct").isNotNull()
        & (F.abs(F.col("us") - F.col("arrived_us")) <= skew_us)
    ).withColumn("chunk", floor_div(F.col("us"), chunk_us))
    rows = laid_by(rows, CELL)
    w = Window.partitionBy(*KEYS, "chunk").orderBy("us", "arrived_us", "in_oct")
    return (
        rows.withColumn("_before", F.lag("us").over(w))
        .where(F.col("_before").isNull() | (F.col("_before") != F.col("us")))
        .select(*KEYS, "chunk", "us", "in_oct")
    )


def reading_steps(ifc: DataFrame, skew_us: int = 48 * HOUR_US, chunk_us: int = CHUNK_US) -> DataFrame:
    """Usable readings with what came before them.

    Columns: exporter, ifindex, chunk, us, in_oct, contradicted, prev_us, prev_oct (of the reading before that isn't
    contradicted; null for the first), run_us (start of the run of equal counters inside the chunk; null if contradicted),
    first_in_chunk (the first reading of the chunk that isn't contradicted).  Laid by CELL.

    A reading is contradicted when its neighbours agree (before <= after) and it lies outside them.
    """
    # Both tables lie by CELL, and what chunks learn of each other is one row each, hashed: so the readings move once and are
    # sorted for each table only.
    readings = cut(usable_readings(ifc, skew_us, chunk_us), "readings", CELL, laid=True)
    edges = readings.groupBy(*CELL).agg(F.min_by("in_oct", "us").alias("first_oct"), F.max_by("in_oct", "us").alias("last_oct"))
    over = Window.partitionBy(*KEYS).orderBy("chunk")
    edges = edges.select(*CELL, F.lag("last_oct").over(over).alias("edge_before"), F.lead("first_oct").over(over).alias("edge_after"))
    w = Window.partitionBy(*CELL).orderBy("us")
    before = F.coalesce(F.lag("in_oct").over(w), F.col("edge_before"))
    after = F.coalesce(F.lead("in_oct").over(w), F.col("edge_after"))
    at = F.col("in_oct")
    kept = ~F.col("contradicted")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        readings.join(edges.hint("shuffle_hash"), CELL)
        .withColumn("_before", before)
        .withColumn("_after", after)
        .withColumn("contradicted", F.coalesce((F.col("_before") <= F.col("_after")) & ((at < F.col("_before")) | (at > F.col("_after"))), F.lit(False)))
        .withColumn("prev_us", F.last(F.when(kept, F.col("us")), ignorenulls=True).over(back))
        .withColumn("prev_oct", F.last(F.when(kept, at), ignorenulls=True).over(back))
        .withColumn("run_us", F.last(F.when(kept & (F.col("prev_oct").isNull() | (F.col("prev_oct") != at)), F.col("us")), ignorenulls=True).over(upto))
        .select(*CELL, "us", "in_oct", "contradicted", "prev_us", "prev_oct", F.when(kept, F.col("run_us")).alias("run_us"))
    )
    steps = cut(steps, "steps", CELL, laid=True)
    # Rows without a kept reading before them in their chunk take the last one of the chunks before; a chunk may hold
    # contradicted readings only and still asks for it.
    last = steps.groupBy(*CELL).agg(F.max(F.when(kept, F.col("us"))).alias("last_us"), F.max_by("in_oct", F.when(kept, F.col("us"))).alias("last_oct"))
    back = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*CELL, F.last("last_us", ignorenulls=True).over(back).alias("far_us"), F.last("last_oct", ignorenulls=True).over(back).alias("far_oct"))
    head = F.col("prev_us").isNull()
    return steps.join(carried.hint("shuffle_hash"), CELL).select(
        *CELL, "us", "in_oct", "contradicted", F.coalesce("prev_us", "far_us").alias("prev_us"), F.when(head, F.col("far_oct")).otherwise(F.col("prev_oct")).alias("prev_oct"),
        "run_us", (head & kept).alias("first_in_chunk"),
    )


def seconds_between() -> Column:
    return (F.col("us") - F.col("prev_us")) / F.lit(1e6)


def rate(gap_us: int = HOUR_US) -> Column:
    """Bits per second from the reading before to this one; null where the counter fell or gap_us or more passed."""
    ok = ~F.col("contradicted") & (F.col("in_oct") >= F.col("prev_oct")) & (F.col("us") - F.col("prev_us") < gap_us)
    return F.when(ok, F.lit(8.0) * (F.col("in_oct") - F.col("prev_oct")) / seconds_between())


def interface_speed(ifc: DataFrame) -> DataFrame:
    """exporter, ifindex, speed: the largest known speed in the interface's rows, usable or not."""
    return (
        ifc.select(address(F.col("exporter")).alias("exporter"), F.col("ifindex").cast("long").alias("ifindex"), F.col("speed").cast("long").alias("speed"))
        .where(F.col("exporter").isNotNull() & F.col("ifindex").isNotNull() & (F.col("speed") > 0) & ~F.col("speed").isin(UNKNOWN_SPEEDS))
        .groupBy(*KEYS)
        .agg(F.max("speed").alias("speed"))
    )
