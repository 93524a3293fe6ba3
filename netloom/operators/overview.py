"""The first page: totals with a baseline, shares, and the top of the range; and the report."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from netloom.operators.interfaces import report_interfaces
from netloom.operators.series import series_by_app, total_series
from netloom.operators.topn import top_n
from netloom.operators.totals import totals
from netloom.plans.query import HOUR, Query, trunc
from netloom.plans.tables import Tables

OTHER = "__other__"
RECENT = timedelta(minutes=5)
SEVERITIES = {3: "high", 2: "medium", 1: "low"}


def baseline_shift(span: timedelta) -> tuple[str, timedelta]:
    """What a range is compared with: the day before, the week before, or for long ranges the span before."""
    if span > timedelta(days=7) + HOUR:
        return "prev", span
    return ("week", timedelta(days=7)) if span > 25 * HOUR else ("day", timedelta(days=1))


def totals_with_base(tables: Tables, q: Query) -> DataFrame:
    """which ('now' or the basis), and the totals of the range and of what it is compared with."""
    basis, back = baseline_shift(q.span)
    now, base = totals(tables, q), totals(tables, q.shifted(-back))
    return now.select(F.lit("now").alias("which"), "*").unionByName(base.select(F.lit(basis).alias("which"), "*"))


def shares(tables: Tables, q: Query, dim: str, keep: int) -> DataFrame:
    """key, wire: the keep largest of the dimension's top 20, what else they hold as '__other__' (as is an empty key)."""
    top = top_n(tables, q, dim, 20).select("key", "wire").orderBy(F.desc("wire"), "key")
    rows = top.limit(keep).where("key <> ''")
    rest = top.join(rows.select("key"), "key", "left_anti").groupBy().agg(F.sum("wire").alias("wire")).where("wire > 0")
    return rows.unionByName(rest.select(F.lit(OTHER).alias("key"), "wire"))


def peak(tables: Tables, q: Query, now: datetime | None = None) -> DataFrame:
    """bucket, value of the busiest bucket."""
    return total_series(tables, q, now).orderBy(F.desc("value"), "bucket").limit(1)


def top_with_base(tables: Tables, q: Query, limit: int = 10) -> DataFrame:
    """Top clients with the wire bytes each exchanged, as either end, in the range before: one query for all of them."""
    top = top_n(tables, q, "client", limit)
    before = q.shifted(-baseline_shift(q.span)[1])
    rows = tables.detail(before)
    sides = rows.select(F.col("client").alias("key"), "wire").unionByName(rows.where("server <> client").select(F.col("server").alias("key"), "wire"))
    base = sides.join(top.select("key"), "key", "left_semi").groupBy("key").agg(F.sum("wire").alias("base"))
    return top.join(base, "key", "left").select("key", "wire", F.coalesce("base", F.lit(0)).alias("base"))


def current_rate(tables: Tables, q: Query, now: datetime) -> DataFrame:
    """now_bps, one row: bits per second of the five whole minutes before now, under the filters of q whatever its range."""
    end = trunc(now, timedelta(minutes=1))
    recent = replace(q, start=end - RECENT, end=end)
    return tables.detail(recent).agg((F.coalesce(F.sum("wire"), F.lit(0)) * 8 / RECENT.total_seconds()).alias("now_bps"))


def overview(tables: Tables, q: Query, now: datetime | None = None) -> dict[str, DataFrame]:
    """The page's parts, each a frame of its own that nothing has computed yet."""
    return {
        "totals": totals_with_base(tables, q), "rate": current_rate(tables, q, now or datetime.now(timezone.utc)), "series": series_by_app(tables, q, 8, True, now), "peak": peak(tables, q, now),
        "dir": shares(tables, q, "dir", 4), "proto": shares(tables, q, "proto", 2), "country": shares(tables, q, "country", 3),
        "top_clients": top_with_base(tables, q), "top_services": top_n(tables, q, "service", 10),
        "baseline": total_series(tables, q.shifted(-baseline_shift(q.span)[1]), now),
    }


def report_head(tables: Tables, q: Query, now: datetime | None = None) -> DataFrame:
    """wire, avg_bps, peak_bps, p95_bps (nearest rank over the buckets of the range), one row."""
    series = total_series(tables, q, now).agg(F.max("value").alias("peak_bps"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95_bps"))
    head = totals(tables, q).select("wire", (F.col("wire") * 8 / q.span.total_seconds()).alias("avg_bps"))
    return head.withColumn("_j", F.lit(1)).join(series.withColumn("_j", F.lit(1)), "_j").drop("_j")


def by_severity(found: DataFrame) -> DataFrame:
    """severity (high, medium, low), n: how many findings of each, 0 for none."""
    names = found.sparkSession.createDataFrame(list(SEVERITIES.items()), "sev int, severity string")
    return names.join(found.groupBy("sev").agg(F.count("*").alias("n")), "sev", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def report(tables: Tables, q: Query, found: DataFrame | None = None, names: DataFrame | None = None, now: datetime | None = None, listed: int | None = 50, top: int = 10, findings: int | None = 20) -> dict[str, DataFrame]:
    """The report's parts, each a frame of its own: head, interfaces (the busiest `listed`), the top clients, apps and
    countries, and of the findings in found that touch the range their number by severity and the first ones.

    With a filter on one interface everything but the findings is that interface's.  names: see report_interfaces.
    """
    ifaces = report_interfaces(tables, q, names).orderBy(F.desc(F.col("in_wire") + F.col("out_wire")), "exporter", "ifindex")
    only = [f.value for f in q.filters if f.field == "iface" and not f.neg]
    ifaces = ifaces.where(F.concat_ws("/", "exporter", "ifindex").isin(only)) if only else ifaces
    out = {"head": report_head(tables, q, now), "interfaces": ifaces if listed is None else ifaces.limit(listed)}
    out |= {f"top_{n}": top_n(tables, q, n, top) for n in ("client", "app", "country")}
    if found is not None:
        from netloom.detect.findings import select  # the detection rules read operators, too

        inside = select(found, q.start, q.end, "all", limit=None)
        out |= {"findings_by_severity": by_severity(inside), "findings": inside if findings is None else inside.limit(findings)}
    return out
