"""Interfaces: what they carried by their own counters and by the flows, and how the two agree."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.core.columns import address, floor_div, micros
from netloom.core.counters import CHUNK_US, HOUR_US, KEYS
from netloom.functions.flow import total
from netloom.plans.query import HOUR, Query, step_for, trunc
from netloom.plans.tables import Tables

COUNTERS = ("in_oct", "out_oct", "in_pkts", "out_pkts")


def snapshots(ifc: DataFrame) -> DataFrame:
    """exporter, ifindex, us and the counters; rows without address, index, time or octets left out."""
    rows = ifc.select(
        address(F.col("exporter")).alias("exporter"), F.col("ifindex").cast("long").alias("ifindex"), micros(F.col("ts")).alias("us"), *COUNTERS,
        (F.col("arrived") if "arrived" in ifc.columns else F.col("ts")).alias("arrived"),
    )
    return rows.where("exporter is not null and ifindex is not null and us is not null and in_oct is not null and out_oct is not null")


def intervals(rows: DataFrame, cols: tuple[str, ...], gap_us: int = HOUR_US) -> DataFrame:
    """Each snapshot with the one before it (prev_us, prev_*) where less than gap_us passed and no counter fell.

    Windows run per interface and chunk of time; a snapshot within gap_us of the next chunk is seen from there as well, so
    that one shuffle does and no task holds an interface.  Of snapshots of one moment the first to arrive counts.
    """
    own = floor_div(F.col("us"), CHUNK_US)
    seen = rows.withColumn("own", own).withColumn("chunk", F.explode(F.array_distinct(F.array(F.col("own"), floor_div(F.col("us") + gap_us, CHUNK_US)))))
    w = Window.partitionBy(*KEYS, "chunk").orderBy("us", "arrived")
    first = seen.withColumn("_b", F.lag("us").over(w)).where("_b is null or _b <> us").drop("_b")
    w = Window.partitionBy(*KEYS, "chunk").orderBy("us")
    out = first.withColumn("prev_us", F.lag("us").over(w))
    for c in cols:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
    rose = F.col("prev_us").isNotNull() & (F.col("us") - F.col("prev_us") < gap_us)
    for c in cols:
        rose = rose & (F.col(c) >= F.col(f"prev_{c}"))
    return out.where(F.col("chunk") == F.col("own")).where(rose)


def _shares(pairs: DataFrame, cols: tuple[str, ...], start: Column, end: Column, step_us: int, offset_us: int) -> DataFrame:
    """Exploded buckets with the part of each rise that falls into them; start and end clip the interval."""
    first = floor_div(start + offset_us, step_us)
    last = floor_div(end - 1 + offset_us, step_us)
    cut = pairs.where(end > start).withColumn("lo", start).withColumn("hi", end)
    cells = cut.withColumn("b", F.explode(F.sequence(first, last)))
    b0 = F.col("b") * step_us - offset_us
    ov = F.least(b0 + step_us, F.col("hi")) - F.greatest(b0, F.col("lo"))
    part = ov / (F.col("us") - F.col("prev_us"))
    return cells.select(*KEYS, (b0 / 1_000_000).cast("long").alias("bucket"), (ov / 1e6).alias("secs"), *[((F.col(c) - F.col(f"prev_{c}")) * part).alias(c) for c in cols])


def _us(t) -> int:
    return int(t.timestamp()) * 1_000_000 + t.microsecond


def interface_hours(tables: Tables, q: Query) -> DataFrame:
    """start (epoch seconds), exporter, ifindex, in_oct, out_oct, in_pkts, out_pkts: counter rises by hour.

    An interval's rise is spread over the hours it overlaps; it counts only if every counter rose and under an hour passed.
    Intervals that the range cuts are clipped.
    """
    a, b = _us(q.start), _us(q.end)
    rows = snapshots(tables.ifc).where(F.col("us").between(a - HOUR_US, b + HOUR_US - 1)).where("in_pkts is not null and out_pkts is not null")
    pairs = intervals(rows, COUNTERS)
    cells = _shares(pairs, COUNTERS, F.greatest("prev_us", F.lit(a)), F.least("us", F.lit(b)), HOUR_US, int(q.offset.total_seconds()) * 1_000_000)
    return cells.groupBy(F.col("bucket").alias("start"), *KEYS).agg(*[F.round(F.sum(c)).cast("long").alias(c) for c in COUNTERS])


def interfaces(tables: Tables, q: Query, most: int | None = None) -> DataFrame:
    """exporter, ifindex, speed, counters, in_wire, out_wire, peer: interfaces with counters or flows in the range.

    most: of the interfaces that flows name take this many of each side, the busiest; None for all.  peer: flows were not sampled on it; it is only
    the other end of flows sampled elsewhere on the device.
    """
    known = (
        tables.ifc.where(q.in_range()).select(address(F.col("exporter")).alias("exporter"), F.col("ifindex").cast("long").alias("ifindex"), "speed")
        .where("exporter is not null and ifindex is not null")
        .groupBy(*KEYS).agg(F.coalesce(F.max("speed"), F.lit(0)).alias("speed"), F.lit(True).alias("counters"))
    )
    rows = tables.rows(q.in_range())
    out = known
    for side, name in (("in_if", "in_wire"), ("out_if", "out_wire")):
        flow = rows.where(F.col(side) != 0).groupBy("exporter", F.col(side).cast("long").alias("ifindex")).agg(total("wire").alias(name))
        out = out.join(flow if most is None else flow.orderBy(F.desc(name), "exporter", "ifindex").limit(most), KEYS, "full")
    out = out.select(*KEYS, F.coalesce("speed", F.lit(0)).alias("speed"), F.coalesce("counters", F.lit(False)).alias("counters"), F.coalesce("in_wire", F.lit(0)).alias("in_wire"), F.coalesce("out_wire", F.lit(0)).alias("out_wire"))
    return _mark_peers(tables, q, out)


def _mark_peers(tables: Tables, q: Query, listed: DataFrame) -> DataFrame:
    carried = F.col("in_wire") + F.col("out_wire")
    totals = tables.rows(q.in_range()).groupBy("exporter").agg(F.sum("wire").alias("all_wire"))
    if tables.r_dim is not None:
        wide = Query(trunc(q.start, HOUR), q.end)
        marks = tables.r_dim.where(wide.in_range() & F.col("dim").isin("obsif", "obsunk"))
        seen = (
            marks.where("dim = 'obsif' and val rlike '.+/[0-9]+$'")
            .groupBy(F.regexp_extract("val", "^(.*)/([0-9]+)$", 1).alias("exporter"), F.regexp_extract("val", "^(.*)/([0-9]+)$", 2).cast("long").alias("ifindex"))
            .agg(F.sum("wire").alias("seen")).where("seen > 0")
        )
        unknown = marks.where("dim = 'obsunk'").groupBy(F.col("val").alias("exporter")).agg(F.sum("wire").alias("unknown"))
        device = seen.groupBy("exporter").agg(F.sum("seen").alias("known"))
        out = listed.join(seen, KEYS, "left").join(device, "exporter", "left").join(unknown, "exporter", "left")
    else:
        out = listed.select("*", *[F.lit(None).cast("long").alias(c) for c in ("seen", "known", "unknown")])
    out = out.join(totals, "exporter", "left").fillna(0, ["seen", "known", "unknown", "all_wire"])
    # Without marks for (nearly) all of a device's traffic, an interface on 90 per cent of it is taken as the sampled one.
    loose = (F.col("known") == 0) | (F.col("unknown") > F.expr("known div 20"))
    nearly = loose & (F.col("all_wire") > 0) & (carried >= 0.9 * F.col("all_wire")) & (carried > 0)
    w = Window.partitionBy("exporter")  # at most the interfaces listed for a device
    out = out.withColumn("nearly", nearly).withColumn("any_nearly", F.bool_or("nearly").over(w))
    can_tell = ~loose | F.col("any_nearly")
    peer = (carried > 0) & can_tell & ~((F.col("seen") > 0) | F.col("nearly"))
    return out.select(*KEYS, "speed", "counters", "in_wire", "out_wire", peer.alias("peer"))


def recon_buckets(tables: Tables, q: Query, exporter: str | None = None, ifindex: int | None = None) -> DataFrame:
    """exporter, ifindex, bucket, complete, covered, in_ctr, out_ctr, in_flow, out_flow (bytes), pkts_in, samples_in,
    samples_out per bucket of five minutes or more: counter rises spread over their intervals beside the flows' estimate.

    For one interface, or for all of them at once.  covered: the counters speak for 90 per cent of the bucket at least.
    """
    step = max(step_for(q.span), timedelta(minutes=5))
    start = q.trunc(q.start, step)
    n, step_us = (q.end - start) // step + 1, int(step.total_seconds()) * 1_000_000
    one = (lambda df: df.where((F.col("exporter") == exporter) & (F.col("ifindex") == ifindex))) if exporter is not None else (lambda df: df)
    a, b = _us(start), _us(q.end)
    rows = one(snapshots(tables.ifc)).where(F.col("us").between(a - 10 * 60_000_000, b - 1))
    cols = ("in_oct", "out_oct")
    cells = _shares(intervals(rows, cols), cols, F.greatest("prev_us", F.lit(a)), F.least("us", F.lit(a + n * step_us)), step_us, int(q.offset.total_seconds()) * 1_000_000)
    counted = cells.groupBy(*KEYS, "bucket").agg(F.sum("in_oct").alias("in_ctr"), F.sum("out_oct").alias("out_ctr"), F.sum("secs").alias("secs"))
    wide = Query(start, q.end, offset=q.offset)
    flows, samples = tables.rows(wide.in_range()), F.sum(F.col("pkts") / F.greatest(F.col("mult"), F.lit(1.0)))
    sides = []
    for side, name in (("in_if", "in"), ("out_if", "out")):
        keyed = one(flows.withColumn("ifindex", F.col(side).cast("long")))
        keyed = keyed if exporter is not None else keyed.where("ifindex <> 0")
        sides.append(keyed.groupBy(*KEYS, wide.bucket(step).alias("bucket")).agg(F.sum("wire").alias(f"{name}_flow"), F.sum("pkts").alias(f"pkts_{name}"), samples.alias(f"samples_{name}")))
    out = counted.join(sides[0], [*KEYS, "bucket"], "full").join(sides[1], [*KEYS, "bucket"], "full").fillna(0)
    secs = int(step.total_seconds())
    return out.select(
        *KEYS, "bucket", (F.col("bucket") + secs <= int(q.end.timestamp())).alias("complete"), (F.col("secs") >= 0.9 * secs).alias("covered"),
        "in_ctr", "out_ctr", "in_flow", "out_flow", "pkts_in", "samples_in", "samples_out",
    )


def recon(tables: Tables, q: Query, exporter: str | None = None, ifindex: int | None = None) -> DataFrame:
    """Per interface over the buckets that are complete and covered: deviation of the flows' estimate from the counters,
    its 95 per cent error by the number of samples, and whether a direction had counters but no flow at all."""
    both = recon_buckets(tables, q, exporter, ifindex).where("complete and covered")
    s = both.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("in_ctr", "out_ctr", "in_flow", "out_flow", "pkts_in", "samples_in", "samples_out")], F.count("*").alias("buckets"))
    dev = lambda a: F.when(F.col(f"{a}_ctr") > 0, (F.col(f"{a}_flow") - F.col(f"{a}_ctr")) / F.col(f"{a}_ctr")).otherwise(0.0)
    err = lambda a: F.when(F.col(f"samples_{a}") > 0, 1.96 / F.sqrt(f"samples_{a}")).otherwise(0.0)
    none = lambda a: (F.col(f"{a}_ctr") > 0) & (F.col(f"{a}_flow") == 0)
    return s.select(
        *KEYS, "buckets", dev("in").alias("in_dev"), dev("out").alias("out_dev"), F.floor("in_ctr").cast("long").alias("in_ctr_bytes"), F.col("in_flow").cast("long").alias("in_flow_bytes"),
        F.col("pkts_in").cast("long").alias("in_pkts"), F.col("samples_in").alias("in_samples"), err("in").alias("in_stat_err"), err("out").alias("out_stat_err"),
        none("in").alias("in_no_flow"), none("out").alias("out_no_flow"),
    )


def nearest_rank(c: str, p: float = 0.95) -> Column:
    """The value at rank ceil(p n); for groups bounded by the buckets of a range."""
    return F.expr(f"percentile_disc({p}) within group (order by {c})")


def counter_figures(tables: Tables, q: Query) -> DataFrame:
    """exporter, ifindex, in_avg, in_peak, in95, out_avg, out_peak, out95 (bits/s), coverage, from buckets with counters."""
    step = max(step_for(q.span), timedelta(minutes=5))
    n = (q.end - q.trunc(q.start, step)) // step + 1
    bits = 8 / step.total_seconds()
    b = recon_buckets(tables, q).where("complete and covered").withColumn("i", F.col("in_ctr") * bits).withColumn("o", F.col("out_ctr") * bits)
    return b.groupBy(*KEYS).agg(
        F.avg("i").alias("in_avg"), F.max("i").alias("in_peak"), nearest_rank("i").alias("in95"),
        F.avg("o").alias("out_avg"), F.max("o").alias("out_peak"), nearest_rank("o").alias("out95"), (F.count("*") / n).alias("coverage"),
    )


def flow_figures(tables: Tables, q: Query) -> DataFrame:
    """As counter_figures by flows: peak and percentile over all buckets of the range, empty ones included as 0."""
    step = step_for(q.span)
    wide = q.aligned(step)
    n = (wide.end - wide.start) // step + 1
    n -= n > 1 and wide.end - (wide.start + (n - 1) * step) < timedelta(seconds=15)
    rank = -(-95 * n // 100)
    rows = tables.rows(wide.in_range())
    out = None
    for side, name in (("in_if", "in"), ("out_if", "out")):
        per = rows.where(F.col(side) != 0).groupBy("exporter", F.col(side).cast("long").alias("ifindex"), wide.bucket(step).alias("b")).agg(F.sum("wire").alias("w"))
        v = per.withColumn("v", F.col("w") * 8 / step.total_seconds())
        w = Window.partitionBy(*KEYS)  # at most the buckets of a range
        v = v.withColumn("at", F.row_number().over(w.orderBy("v")) + n - F.count("*").over(w))
        part = v.groupBy(*KEYS).agg((F.sum("w") * 8 / q.span.total_seconds()).alias(f"{name}_avg"), F.max("v").alias(f"{name}_peak"), F.coalesce(F.max(F.when(F.col("at") == rank, F.col("v"))), F.lit(0.0)).alias(f"{name}95"))
        out = part if out is None else out.join(part, KEYS, "full")
    return out.fillna(0.0)


def report_interfaces(tables: Tables, q: Query, names: DataFrame | None = None) -> DataFrame:
    """The report's table: every interface with its figures, from counters where it has any, else from flows.

    names: exporter, ifindex, name, device, speed of the inventory.
    """
    figures = ("in_avg", "in_peak", "in95", "out_avg", "out_peak", "out95")
    c = counter_figures(tables, q).withColumn("source", F.lit("counters"))
    f = flow_figures(tables, q).select(*KEYS, *[F.col(x).alias(f"f_{x}") for x in figures])
    out = interfaces(tables, q).join(c, KEYS, "left").join(f, KEYS, "left")
    has = F.col("source").isNotNull()
    out = out.select(*KEYS, "speed", "in_wire", "out_wire", "peer", F.coalesce("source", F.lit("flows")).alias("source"), *[F.coalesce(F.when(has, F.col(x)).otherwise(F.col(f"f_{x}")), F.lit(0.0)).alias(x) for x in figures], F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    if names is not None:
        known = names.select(*KEYS, "name", "device", F.col("speed").alias("said"))
        out = out.join(known, KEYS, "left").withColumn("speed", F.when(F.col("speed") == 0, F.coalesce("said", F.lit(0))).otherwise(F.col("speed"))).drop("said")
    util = lambda a, b: F.when(F.col("speed") > 0, F.greatest(a, b) / F.col("speed") * 100).otherwise(0.0)
    return out.select("*", util("in_avg", "out_avg").alias("util_avg"), util("in_peak", "out_peak").alias("util_peak"), util("in95", "out95").alias("util95"))
