"""Traffic over time, split by a dimension."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from netloom.functions.flow import ASN, PEER, SERVICE
from netloom.plans.query import HOUR, Query, bucket_count, bucket_seconds, step_for
from netloom.plans.tables import Tables

OTHER = "__other__"


@dataclass(frozen=True)
class Line:
    """key: what one line stands for; cond: rows that have one; rollup: summary, its key and condition; hourly: its grain."""

    key: str
    cond: str = "true"
    rollup: tuple[str, str, str] | None = None
    hourly: bool = False


LINES = {
    "app": Line("app", rollup=("r_ts", "app", "true")),
    "client": Line("client", rollup=("r_host", "ip", "role = 1"), hourly=True),
    "server": Line("server", rollup=("r_host", "ip", "role = 2"), hourly=True),
    "service": Line(SERVICE, "svc_port <> 0", ("r_dim", "val", "dim = 'port' and val not like '0/%'"), True),
    "asn_src": Line(ASN, f"src = {PEER}"),
    "asn_dst": Line(ASN, f"dst = {PEER}"),
    "if_in": Line("concat(exporter, '/', in_if)", "in_if <> 0"),
    "if_out": Line("concat(exporter, '/', out_if)", "out_if <> 0"),
}


def buckets(q: Query, step: timedelta, data_from: datetime | None, now: datetime) -> DataFrame | list[tuple[int, float]]:
    """(start, seconds of data) of each bucket of an aligned query; a few hundred at most."""
    n = bucket_count(q.start, q.end, step)
    return [(int((q.start + i * step).timestamp()), bucket_seconds(q.start, i, step, q.end, data_from, now)) for i in range(n)]


def series_by(
    tables: Tables, q: Query, by: str, measure: str = "wire", k: int = 8, dense: bool = False, now: datetime | None = None
) -> DataFrame:
    """bucket (epoch seconds), name, value (bits or packets per second), amount (bytes or packets).

    The k largest values have lines of their own, the rest is '__other__' (ties by name).  The step is the finest with at
    most 300 points, an hour at least where hourly summaries answer.  dense: a row for every bucket and name, 0 where
    nothing was seen.  now: the moment "the past" is measured from.
    """
    if by not in LINES:
        raise ValueError(f"unknown series {by!r}")
    if measure not in ("wire", "pkts"):
        raise ValueError(f"unknown measure {measure!r}")
    k = k if 0 < k <= 20 else 8
    return _series(tables, q, LINES[by], measure, k, dense, now)


def series_by_app(tables: Tables, q: Query, k: int = 8, dense: bool = False, now: datetime | None = None) -> DataFrame:
    """As series_by with app, for any k."""
    return _series(tables, q, LINES["app"], "wire", k, dense, now)


def _rows(tables: Tables, q: Query, line: Line) -> tuple[DataFrame, Query, timedelta]:
    step = step_for(q.span)
    rollup = tables.rollup(q, line.rollup[0]) if line.rollup else None
    if rollup is not None and line.hourly:
        step = max(step, HOUR)
    aligned = q.aligned(step)
    if rollup is not None:
        # chosen for the range as asked, read for the range as drawn
        wide = tables.rollup(aligned, line.rollup[0])
        return wide.where(line.rollup[2]).select(aligned.bucket(step).alias("bucket"), F.col(line.rollup[1]).alias("name"), "wire", "pkts"), aligned, step
    return tables.detail(aligned).where(line.cond).select(aligned.bucket(step).alias("bucket"), F.expr(line.key).alias("name"), "wire", "pkts"), aligned, step


def _series(tables: Tables, q: Query, line: Line, measure: str, k: int, dense: bool, now: datetime | None) -> DataFrame:
    rows, q, step = _rows(tables, q, line)
    spark = rows.sparkSession
    now = now or datetime.now(timezone.utc)
    top = rows.groupBy("name").agg(F.sum(measure).alias("_t")).orderBy(F.desc("_t"), "name").limit(k).select(F.col("name").alias("kept"))
    # top holds k rows
    named = rows.join(F.broadcast(top), rows["name"].eqNullSafe(top["kept"]), "left").withColumn("name", F.when(F.col("kept").isNotNull(), F.col("name")).otherwise(OTHER))
    sums = named.groupBy("bucket", "name").agg(F.sum(measure).alias("amount"))
    grid = spark.createDataFrame(buckets(q, step, tables.data_from, now), "bucket long, secs double")
    if dense:
        names = sums.select("name").distinct()
        every = names.withColumn("at", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(s).alias("secs")) for b, s in buckets(q, step, tables.data_from, now)]))).select("name", "at.*")
        out = every.join(sums, ["bucket", "name"], "left").fillna(0, ["amount"])
    else:
        out = sums.join(F.broadcast(grid), "bucket")  # at most a few hundred rows
    factor = 8.0 if measure == "wire" else 1.0
    return out.select("bucket", "name", (F.col("amount") * factor / F.col("secs")).alias("value"), "amount")


def series_totals(tables: Tables, q: Query, by: str, measure: str = "wire", k: int = 8) -> DataFrame:
    """name, amount: each line's total over the range, '__other__' last."""
    out = series_by(tables, q, by, measure, k).groupBy("name").agg(F.sum("amount").alias("amount"))
    return out.orderBy(F.col("name") == OTHER, F.desc("amount"), "name")


def distinct_values(tables: Tables, q: Query, by: str) -> DataFrame:
    """How many values the dimension had, to within a per cent (a sketch of some kilobytes)."""
    return _rows(tables, q, LINES[by])[0].agg(F.approx_count_distinct("name", 0.01).alias("n"))


def total_series(tables: Tables, q: Query, now: datetime | None = None) -> DataFrame:
    """bucket, value of all traffic, every bucket of the range."""
    rows, q, step = _rows(tables, q, LINES["app"])
    grid = rows.sparkSession.createDataFrame(buckets(q, step, tables.data_from, now or datetime.now(timezone.utc)), "bucket long, secs double")
    sums = rows.groupBy("bucket").agg(F.sum("wire").alias("amount"))
    return grid.join(sums, "bucket", "left").select("bucket", (F.coalesce("amount", F.lit(0)) * 8.0 / F.col("secs")).alias("value"))
