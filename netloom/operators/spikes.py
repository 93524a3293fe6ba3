"""Implausible counter readings: contradictions, range, constant runs, and outliers of a robust decomposition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.core.arrow import rows_mapped
from netloom.core.columns import floor_div
from netloom.core.counters import CELL, CHUNK_US, HOUR_US, KEYS, interface_speed, rate, reading_steps
from netloom.core.order_stats import bracketed_medians
from netloom.core.shared import cut

DAY_US = 24 * HOUR_US
#: Turns a median absolute deviation into the standard deviation of normal data.
MAD_TO_SD = 1.4826
#: Sizes are counted in bins of this relative width; zero has a bin of its own.
WIDTH, ZERO = 0.05, -1_000_000


def size_bin(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log(size) / WIDTH)).otherwise(F.lit(ZERO)).cast("int")


def bin_size(b: np.ndarray) -> np.ndarray:
    return np.where(b == ZERO, 0.0, np.exp((np.maximum(b, -10_000) + 0.5) * WIDTH))


def esd_limits(n: float, i: np.ndarray, alpha: float) -> np.ndarray:
    """Critical values of the i-th most extreme of n values in the generalised extreme studentised deviate test; infinite where
    fewer than three values are left.  Normal quantiles by a rational approximation (error below 5e-4), Student's by their
    expansion in 1 / df."""
    df = np.maximum(n - i - 1, 1.0)
    u = np.sqrt(-2 * np.log(alpha / (2 * (n - i + 1))))
    z = u - (2.515517 + 0.802853 * u + 0.010328 * u * u) / (1 + 1.432788 * u + 0.189269 * u * u + 0.001308 * u * u * u)
    t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
    return np.where(n - i - 1 >= 1, (n - i) * t / np.sqrt((df + t * t) * (n - i + 1)), np.inf)


def extreme(size: np.ndarray, count: np.ndarray, alpha: float, least: float = 0.0) -> np.ndarray:
    """Which bins of deviations (their sizes, rising, and counts) the generalised ESD test finds extreme.

    From the largest down: each bin is studentised by the median of the deviations that remain when all larger ones are
    removed (the scale is estimated anew each time; least is its lower bound) and compared with the critical value of its
    rank.  The lowest bin that exceeds its limit decides, and up to half of the values may go.
    """
    left = np.cumsum(count)
    n = int(left[-1])
    i = n - left + 1.0
    scale = np.maximum(MAD_TO_SD * size[np.searchsorted(left, (left + 1) // 2)], least)
    with np.errstate(divide="ignore", invalid="ignore"):
        beyond = np.where(size > 0, size / scale, 0.0) > esd_limits(n, i, alpha)
    found = np.flatnonzero(beyond & (2 * i <= n))
    return np.arange(len(size)) >= (found[0] if len(found) else len(size))


LIMITS = "exporter string, ifindex long, rest_from int, high_from int, low_to int, ends array<double>"


def interface_limits(alpha: float, factor: float):
    """mapInArrow function over exporter, ifindex, middle, bins (kind, b, n): the bins from which on residuals are extreme, and
    rates are above and below the middle; the bracket of the median of the rates above zero, if one may be factor times it."""

    def one(row: dict) -> dict:
        bins = {k: np.array(sorted((x["b"], x["n"]) for x in row["bins"] if x["kind"] == k), np.int64).reshape(-1, 2).T for k in (0, 1)}
        out = {"exporter": row["exporter"], "ifindex": row["ifindex"]}
        (b, n), (r, m) = bins[0], bins[1]
        if len(b):
            far = b[extreme(bin_size(b), n, alpha)]
            out["rest_from"] = int(far[0]) if len(far) else None
        if len(r):
            away = np.abs(bin_size(r) - row["middle"])
            order = np.argsort(away, kind="stable")
            far = r[order][extreme(away[order], m[order], alpha, WIDTH / 2 * row["middle"])]
            high, low = far[bin_size(far) > row["middle"]], far[bin_size(far) < row["middle"]]
            out |= {"high_from": int(high.min()) if len(high) else None, "low_to": int(low.max()) if len(low) else None}
            up, times = r[r != ZERO], m[r != ZERO]
            if len(up):
                upto = np.cumsum(times)
                lo, hi = (int(up[np.searchsorted(upto, k)]) for k in ((upto[-1] + 1) // 2, upto[-1] // 2 + 1))
                if np.exp((up[-1] + 1) * WIDTH) >= 0.999 * factor * np.exp(lo * WIDTH):
                    out["ends"] = [float(np.exp(lo * WIDTH) * (1 - 1e-9)), float(np.exp((hi + 1) * WIDTH) * (1 + 1e-9))]
        return out

    return lambda row: [one(row)]


def stuck_runs(steps: DataFrame, run: int, share: float) -> DataFrame:
    """exporter, ifindex, chunk, stuck_runs: the chunk's runs of equal counters that are part of a run of run or more readings.

    Only interfaces where less than share of the readings repeat the one before.  A run may cross chunks: its parts are
    counted per chunk and joined through one row per (interface, chunk).
    """
    kept = steps.where("not contradicted").withColumn("repeats", F.coalesce(F.col("in_oct") == F.col("prev_oct"), F.lit(False)))
    chunks = kept.groupBy(*KEYS, "chunk").agg(
        F.min("run_us").alias("first_run"), F.max("run_us").alias("last_run"),
        F.bool_or(F.col("first_in_chunk") & F.col("repeats")).alias("goes_on"),
        F.count("*").alias("n"), F.count(F.when(F.col("repeats"), 1)).alias("again"),
    )
    whole = Window.partitionBy(*KEYS)
    back = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("goes_on") & (F.col("first_run") == F.col("last_run"))
    chunks = (
        chunks.withColumn("carried", F.last(F.when(~inside, F.col("last_run")), ignorenulls=True).over(back))
        .withColumn("_again", F.sum("again").over(whole))
        .withColumn("_n", F.sum("n").over(whole))
        .where(F.col("_again") < F.col("_n") * share)
    )
    parts = kept.where("repeats").groupBy(*KEYS, "chunk", "run_us").agg(F.count("*").alias("part"))
    joined = parts.join(chunks.select(*KEYS, "chunk", "first_run", "goes_on", "carried"), [*KEYS, "chunk"]).withColumn(
        "run", F.when(F.col("goes_on") & (F.col("run_us") == F.col("first_run")), F.col("carried")).otherwise(F.col("run_us"))
    )
    return (
        joined.withColumn("repeats", F.sum("part").over(Window.partitionBy(*KEYS, "run")))
        .where(F.col("repeats") >= run - 1)
        .groupBy(*KEYS, "chunk")
        .agg(F.collect_list("run_us").alias("stuck_runs"))
    )


def reading_checks(
    ifc: DataFrame, factor: float = 15.0, run: int = 6, repeat_share: float = 0.2, alpha: float = 0.05,
    gap_us: int = HOUR_US, skew_us: int = 48 * HOUR_US,
) -> DataFrame:
    """Every usable reading with what speaks against it, measured by its own interface.

    Columns: exporter, ifindex, us, in_oct, rate, speed, median (of the interface's rates above zero, where some rate is
    factor times it or nearly; else null), expected (trend + seasonal), residual, contradicted, over_speed, outlier,
    off_level, far_above, stuck.

    Decomposition: of every hour the median rate; seasonal = median of an hour of day over the days, less the interface's
    middle, the median of all its hours; trend = median per day of the hours without their seasonal part.  outlier: the
    residual is extreme by a generalised extreme studentised deviate test at alpha that estimates its scale anew as it
    removes points, over counts of residuals by size (see extreme).  off_level: the rate itself is, by its distance from the
    middle (so a high rate that comes every day is seen, too).  far_above: outlier or off_level, and then the exact check:
    at least factor times the median.  The test keeps every such rate for the check: rates are not negative, so the median
    distance is at most the middle and a rate of 15 medians lies at least 9 deviations off, while a critical value stays
    below both the root of the number of rates and 7 up to 1e10 of them.  over_speed: rate above the interface's largest
    known speed.  stuck: see stuck_runs, all but the first of a run.

    Unusable rows are ignored (see usable_readings), an interface with no rate has null rate, median and residual and can
    only be contradicted or stuck; an empty table gives an empty result; other columns don't matter.  Statistics are taken of
    the hours, and reach the readings through one row per (interface, chunk of time), so no task holds an interface; an
    interface's counts by size are a few hundred, however many readings it has.
    """
    steps = cut(reading_steps(ifc, skew_us).withColumn("rate", rate(gap_us)).withColumn("slot", floor_div(F.col("us"), HOUR_US)), "rates", CELL, laid=True)
    rates = steps.where(F.col("rate").isNotNull())
    chunks = steps.select(*KEYS, "chunk").distinct().withColumn("day", floor_div(F.col("chunk") * CHUNK_US, DAY_US))
    typical = lambda c, accuracy=1_000: F.percentile_approx(c, 0.5, accuracy)

    hours = rates.groupBy(*KEYS, "chunk", "slot").agg(typical("rate").alias("typical"))
    hours = cut(hours.select(*KEYS, "typical", F.pmod("slot", F.lit(24)).cast("int").alias("hour"), floor_div(F.col("slot"), 24).alias("day")), "hours")
    middle = hours.groupBy(*KEYS).agg(typical("typical", 10_000).alias("middle"))
    season = hours.groupBy(*KEYS, "hour").agg(typical("typical").alias("t")).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("hour", "t"))).alias("typical"))
    base = cut(middle.join(season, KEYS), "season")
    seasonal = F.element_at("season", F.col("hour")) - F.col("middle")
    days = hours.join(base.withColumnRenamed("typical", "season"), KEYS).groupBy(*KEYS, "day").agg(typical(F.col("typical") - seasonal).alias("trend"))
    base = cut(chunks.join(base.withColumnRenamed("typical", "season"), KEYS, "left").join(days, [*KEYS, "day"], "left"), "base")
    hour = F.pmod("slot", F.lit(24)).cast("int")
    expected = F.col("trend") + F.element_at("season", hour) - F.col("middle")

    # The facts are one row per chunk: hashed, so that the readings needn't be sorted for them.
    facts_by_chunk = lambda df: df.hint("shuffle_hash")
    apart = rates.join(facts_by_chunk(base), [*KEYS, "chunk"]).select(*KEYS, "middle", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), size_bin(F.abs(F.col("rate") - expected)).alias("b")),
        F.struct(F.lit(1).alias("kind"), size_bin(F.col("rate")).alias("b")),
    )).alias("x"))
    counts = apart.groupBy(*KEYS, "middle", "x").agg(F.count("*").alias("n"))
    bins = counts.groupBy(*KEYS, "middle").agg(F.collect_list(F.struct("x.kind", "x.b", "n")).alias("bins"))
    limits = cut(rows_mapped(bins, interface_limits(alpha, factor), LIMITS), "limits")
    near = rates.join(facts_by_chunk(chunks.select(*KEYS, "chunk").join(limits.where("ends is not null").select(*KEYS, "ends"), KEYS)), [*KEYS, "chunk"])
    medians = bracketed_medians(near.where("rate > 0"), KEYS, "rate", "ends")
    facts = (
        base.join(limits.drop("ends"), KEYS, "left")
        .join(medians, KEYS, "left")
        .join(interface_speed(ifc), KEYS, "left")
        .join(stuck_runs(steps, run, repeat_share), [*KEYS, "chunk"], "left")
    )
    false = F.lit(False)
    outlier = size_bin(F.abs(F.col("rate") - expected)) >= F.col("rest_from")
    off_level = F.coalesce(size_bin(F.col("rate")) >= F.col("high_from"), false) | F.coalesce(size_bin(F.col("rate")) <= F.col("low_to"), false)
    checked = steps.join(facts_by_chunk(facts), [*KEYS, "chunk"], "left")
    return checked.withColumn("outlier", F.coalesce(outlier, false)).withColumn("off_level", off_level).select(
        *KEYS, "us", "in_oct", "rate", "speed", "median", expected.alias("expected"), (F.col("rate") - expected).alias("residual"),
        "contradicted",
        F.coalesce(F.col("rate") > F.col("speed"), false).alias("over_speed"), "outlier", "off_level",
        F.coalesce((F.col("outlier") | F.col("off_level")) & (F.col("rate") >= factor * F.col("median")), false).alias("far_above"),
        (~F.col("contradicted") & F.coalesce((F.col("in_oct") == F.col("prev_oct")) & F.array_contains("stuck_runs", F.col("run_us")), false)).alias("stuck"),
    )


def implausible_readings(ifc: DataFrame) -> DataFrame:
    """exporter, ifindex, ts_us of readings that are contradicted, over speed, far above the usual or stuck."""
    return reading_checks(ifc).where("contradicted or over_speed or far_above or stuck").select(*KEYS, F.col("us").alias("ts_us"))
