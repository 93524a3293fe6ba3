"""Irregular counter readings onto a regular time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.core.columns import floor_div
from netloom.core.counters import HOUR_US, KEYS, reading_steps

SLOT_US = 300_000_000


def counter_grid(ifc: DataFrame, slot_us: int = SLOT_US, gap_us: int = HOUR_US, skew_us: int = 48 * HOUR_US) -> DataFrame:
    """One row per interface and period between the periods of its first and last usable readings.

    Columns: exporter, ifindex, slot_s (start of the period, epoch seconds), readings (usable readings inside), octets
    (traffic, null where none is known), covered_us (part of the period whose traffic is known), state.

    The rise between consecutive readings is spread over the periods between them in proportion to their overlap; shares
    are differences of rounded running totals, so they add up to the rise exactly.  A fall of the counter is a reset: the
    interval before it is uncovered, as is one of gap_us or more.  Contradicted readings count as readings but carry no
    traffic.  state: measured (readings, wholly covered), filled (no reading, wholly covered from its neighbours), partial,
    missing (nothing known).

    Unusable rows (see usable_readings) are ignored; an empty table gives an empty result; repeated rows count once; other
    columns don't matter.  No window spans an interface and shares are added up per (interface, period), so an interface
    may hold any part of all rows.
    """
    steps = reading_steps(ifc, skew_us)
    slot = floor_div(F.col("us"), slot_us)
    before = floor_div(F.col("prev_us"), slot_us)
    paired = ~F.col("contradicted") & F.col("prev_us").isNotNull()
    rise = F.col("in_oct") - F.col("prev_oct")
    known = paired & (rise >= 0) & (F.col("us") - F.col("prev_us") < gap_us)
    cells = steps.select(
        *KEYS, "us", "prev_us", slot.alias("own"), F.when(known, rise).alias("rise"),
        F.explode(F.when(paired, F.sequence(before, slot)).otherwise(F.array(slot))).alias("slot"),
    )
    start = F.greatest(F.col("prev_us"), F.col("slot") * slot_us)
    end = F.least(F.col("us"), (F.col("slot") + 1) * slot_us)

    def total(at: Column) -> Column:
        return F.round(F.col("rise") * ((at - F.col("prev_us")) / (F.col("us") - F.col("prev_us")))).cast("long")

    share = F.when(F.col("rise").isNotNull(), total(end) - total(start))
    grid = (
        cells.groupBy(*KEYS, "slot")
        .agg(
            F.count(F.when(F.col("own") == F.col("slot"), 1)).alias("readings"),
            F.sum(share).alias("octets"),
            F.sum(F.when(F.col("rise").isNotNull(), end - start).otherwise(F.lit(0))).alias("covered_us"),
        )
        .select(*KEYS, (F.col("slot") * (slot_us // 1_000_000)).alias("slot_s"), "readings",
                F.when(F.col("covered_us") > 0, F.col("octets")).alias("octets"), "covered_us")
    )
    state = (
        F.when(F.col("covered_us") == 0, "missing")
        .when(F.col("covered_us") < slot_us, "partial")
        .when(F.col("readings") > 0, "measured")
        .otherwise("filled")
    )
    return grid.withColumn("state", state)


def empty_periods(ifc: DataFrame, slot_us: int = SLOT_US) -> DataFrame:
    """exporter, ifindex, slot_s of the grid's periods without a usable reading."""
    return counter_grid(ifc, slot_us).where("readings = 0").select(*KEYS, "slot_s")
