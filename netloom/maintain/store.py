"""The stored tables: flow rows by date and hour, and rollups by date, changed commit by commit."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netloom.core.columns import as_timestamp
from netloom.core.commits import Commits
from netloom.core.shared import cut
from netloom.operators import rollups
from netloom.plans.query import HOUR, trunc, utc
from netloom.plans.tables import ARRIVAL, Tables, blanked_flows

#: Days that detail and summaries are kept; counters as long as summaries.
DETAIL_DAYS, SUMMARY_DAYS = 30, 400
FORMAT = 1
GRACE = timedelta(minutes=5)
FLOW_KEY = ["ts", "src", "dst", "sport", "dport", "proto"]
SUMMARIES = ("r_ts", "r_host", "r_dim", "r_ts_if", "r_dim_if")
TABLES = ("flows", "hot", *SUMMARIES, "ifc")
PART = {"flows": ["date", "hour"], "hot": ["date", "hour"]}
_LOCK = threading.Lock()


def _begin(part: str) -> datetime:
    """The moment a partition begins."""
    named = dict(x.split("=") for x in part.split("/"))
    return utc(datetime.fromisoformat(named["date"])) + int(named.get("hour", 0)) * HOUR


def _length(part: str) -> timedelta:
    return HOUR if "hour=" in part else timedelta(days=1)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def promoted(rows: DataFrame) -> DataFrame:
    """One remaining copy of each flow counts where the one that did was deleted."""
    w = Window.partitionBy(*FLOW_KEY)
    has = F.bool_or(~F.col("dup")).over(w)
    first = F.row_number().over(w.orderBy("exporter", "in_if", "out_if", "wire", "pkts"))
    return rows.withColumn("_has", has).withColumn("_n", first).withColumn("dup", F.col("dup") & (F.col("_has") | (F.col("_n") > 1))).drop("_has", "_n")


#: One change of a table: a partition, the versions of it that go (they must be there), the version that comes.
Change = tuple[str, str, tuple[str, ...], str | None]


class Store:
    """Tables as sets of files named by commits.

    Every write goes to a folder of its own, <table>/version=<v>/date=.../, and counts when a commit names it; every
    operation is one commit, however many tables it changes.  What stops before its commit has changed nothing and can be
    run again; what stops after it leaves files that nothing names (sweep() deletes them).  Rows appended while an operation
    runs stay: it takes away the versions it has read, no others.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = Commits(spark, folder)

    # -- commits
    def _state(self) -> dict[str, dict[str, list[str]]]:
        return self.commits.last()[1] or {}

    def _change(self, changes: list[Change]) -> None:
        """Commit changes on top of the newest state, whoever made it."""
        if not changes:
            return
        self.check_format()
        for _ in range(100):
            number, state = self.commits.last()
            state = state or {}
            for table, part, gone, come in changes:
                own = state.setdefault(table, {}).get(part, [])
                if not set(gone) <= set(own):
                    raise RuntimeError(f"{table}/{part} was changed by another operation")
                left = [v for v in own if v not in gone] + ([come] if come else [])
                if left:
                    state[table][part] = left
                else:
                    state[table].pop(part, None)
            with _LOCK:
                if self.commits.commit(number + 1, state):
                    break
        else:
            raise RuntimeError("no commit could be made")
        fs = self.commits.fs()
        for table, part, gone, _ in changes:
            for v in gone:
                fs.delete(self.commits.path(f"{table}/version={v}/{part}"), True)

    def sweep(self) -> int:
        """Delete versions that no commit names; only while nothing else writes. The number deleted."""
        state, fs, n = self._state(), self.commits.fs(), 0
        for table in TABLES:
            named = {v for versions in state.get(table, {}).values() for v in versions}
            for name in self.commits.names(table):
                if name.removeprefix("version=") not in named:
                    n += bool(fs.delete(self.commits.path(f"{table}/{name}"), True))
        return n

    def exists(self, table: str) -> bool:
        """Whether the table holds anything."""
        return bool(self._state().get(table))

    def check_format(self) -> None:
        """Refuse data written by a later version; mark a new folder with this one."""
        fs, at = self.commits.fs(), self.commits.path("FORMAT.json")
        if fs.exists(at):
            version = self.spark.read.json(f"{self.folder}/FORMAT.json").first()["version"]
            if version > FORMAT:
                raise RuntimeError(f"the data has format {version}; this engine reads up to {FORMAT}")
            return
        out = fs.create(at, True)
        out.write(bytearray(json.dumps({"version": FORMAT}).encode()))
        out.close()

    # -- reading and writing
    def _frame(self, table: str, parts: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.folder}/{table}/version={v}/{p}" for p, versions in parts.items() for v in versions]
        return self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.folder}/{table}").parquet(*paths).drop("version")

    def read(self, table: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """A table, of which only the partitions in [start, end) are read. Columns are matched by name over all files."""
        parts = self._state().get(table)
        if not parts:
            raise ValueError(f"the store holds no {table}")
        span = {p: v for p, v in parts.items() if (start is None or _begin(p) + _length(p) > utc(start)) and (end is None or _begin(p) < utc(end))}
        if not span:
            return self._frame(table, dict([next(iter(parts.items()))])).where("false")
        df = self._frame(table, span)
        df = df if start is None else df.where(F.col("ts") >= F.lit(utc(start)))
        return df if end is None else df.where(F.col("ts") < F.lit(utc(end)))

    def flows(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Sealed rows and those not sealed yet."""
        parts = [self.read(t, start, end) for t in ("flows", "hot") if self.exists(t)]
        return _union(parts)

    def tables(self) -> Tables:
        """The stored tables as queries take them: records are stored once, so nothing looks for second deliveries."""
        flows = blanked_flows(self.flows()).drop(*ARRIVAL)
        kept = {n: self.read(n) for n in (*SUMMARIES, "ifc") if self.exists(n)}
        return Tables(flows, **kept, data_from=utc(self.data_start()))

    @staticmethod
    def _dated(df: DataFrame, table: str) -> DataFrame:
        ts = as_timestamp(F.col("ts"))
        df = df.withColumn("ts", ts).withColumn("date", F.to_date(ts))
        return df.withColumn("hour", F.hour(ts)) if table in PART else df

    def _written(self, table: str, df: DataFrame) -> tuple[str, list[str]]:
        """Write df as a version that no commit names yet; its name and partitions."""
        version, dated = uuid.uuid4().hex[:16], self._dated(df, table)
        if table == "flows":
            # Row groups then cover short spans of time and addresses; an hour may be many tasks.
            dated = dated.repartitionByRange("date", "hour", "ts").sortWithinPartitions("ts", "client")
        by = PART.get(table, ["date"])
        dated.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.folder}/{table}/version={version}")
        parts = [n for n in self.commits.names(f"{table}/version={version}") if n.startswith("date=")]
        if len(by) > 1:
            parts = [f"{d}/{h}" for d in parts for h in self.commits.names(f"{table}/version={version}/{d}") if h.startswith("hour=")]
        return version, parts

    def _added(self, table: str, df: DataFrame) -> list[Change]:
        version, parts = self._written(table, df)
        return [(table, p, (), version) for p in parts]

    def _replaced(self, table: str, df: DataFrame, old: dict[str, list[str]]) -> list[Change]:
        """df instead of the partitions old, as they were read."""
        version, parts = self._written(table, df)
        return [(table, p, tuple(old.get(p, ())), version if p in parts else None) for p in {*old, *parts}]

    def append(self, table: str, df: DataFrame) -> None:
        self._change(self._added(table, df))

    def _parts(self, table: str, wanted: Callable[[str], bool] = lambda p: True) -> dict[str, list[str]]:
        return {p: v for p, v in self._state().get(table, {}).items() if wanted(p)}

    # -- sealing
    def seal(self, now: datetime) -> int:
        """Move the hours that ended five minutes ago or more from hot to flows, sorted, with their view summaries.

        An hour that was sealed before is rewritten with what came late.  Returns the hours sealed.
        """
        edge = trunc(utc(now) - GRACE, HOUR)
        ready = self._parts("hot", lambda p: _begin(p) < edge)
        if not ready:
            return 0
        new = cut(self._frame("hot", ready).drop("date", "hour"), "sealing")
        old = self._parts("flows", lambda p: p in ready)
        whole = _union([*([self._frame("flows", old).drop("date", "hour")] if old else []), new])
        changes = self._replaced("flows", whole, old)
        for name in ("r_ts_if", "r_dim_if"):
            changes += self._added(name, rollups.ALL[name](new))
        self._change([*changes, *[("hot", p, tuple(v), None) for p, v in ready.items()]])
        return len(ready)

    def compact(self, now: datetime, most: int = 16) -> int:
        """Put together the partitions of days past that lie in more than `most` versions; the number of them."""
        today, n = utc(now).replace(hour=0, minute=0, second=0, microsecond=0), 0
        for table in (*SUMMARIES, "ifc"):
            crowded = {p: v for p, v in self._parts(table).items() if len(v) > most and _begin(p) < today}
            if crowded:
                rows = self._frame(table, crowded).drop("date").repartitionByRange("ts")
                self._change(self._replaced(table, rows, crowded))
                n += len(crowded)
        return n

    # -- retention and purging
    def retain(self, now: datetime, detail: int = DETAIL_DAYS, summary: int = SUMMARY_DAYS, counters: int = SUMMARY_DAYS) -> dict[str, int]:
        """Drop the partitions that lie before the cut of their table, whole days at a time; the number dropped."""
        out, changes = {}, []
        for table, days in [("flows", detail), *[(t, summary) for t in SUMMARIES], ("ifc", counters)]:
            cut_day = (utc(now) - timedelta(days=days)).date()
            old = self._parts(table, lambda p: _begin(p).date() < cut_day)
            changes += [(table, p, tuple(v), None) for p, v in old.items()]
            out[table] = len(old)
        self._change(changes)
        return out

    def purge(self, before: datetime | None = None) -> None:
        """Delete everything before a moment, or everything. Partitions that the moment cuts are rewritten."""
        changes: list[Change] = []
        for table in TABLES:
            edge = utc(before) if before else None
            gone = self._parts(table, lambda p: edge is None or _begin(p) + _length(p) <= edge)
            changes += [(table, p, tuple(v), None) for p, v in gone.items()]
            across = self._parts(table, lambda p: edge is not None and _begin(p) < edge < _begin(p) + _length(p))
            if across:
                changes += self._replaced(table, self._frame(table, across).where(F.col("ts") >= F.lit(edge)).drop(*PART.get(table, ["date"])), across)
        self._change(changes)

    def purge_size(self, before: datetime) -> DataFrame:
        """table, rows that purge(before) would delete."""
        return _union([self.read(t, None, before).agg(F.lit(t).alias("table"), F.count("*").alias("rows")) for t in TABLES if self.exists(t)])

    def purge_exporter(self, exporter: str) -> int:
        """Delete everything one device reported. Where another reported the same traffic its copy counts from now on; the
        overall summaries of the touched hours are made anew. Returns the number of touched hours."""
        rows = self.flows().where(F.col("exporter") == exporter).select("date", "hour").distinct().collect()
        touched = {f"date={r.date}/hour={r.hour}" for r in rows}
        own = (F.col("iface") == exporter) | F.col("iface").startswith(exporter + "/")
        marks = F.col("dim").isin("obsif", "obsunk") & ((F.col("val") == exporter) | F.col("val").startswith(exporter + "/"))
        changes: list[Change] = []
        if touched:
            begin, end = min(map(_begin, touched)), max(map(_begin, touched)) + HOUR
            span = {t: self._parts(t, lambda p: begin <= _begin(p) < end) for t in ("flows", "hot")}
            kept = {}
            for table, parts in span.items():
                if parts:
                    kept[table] = cut(self._frame(table, parts).where(F.col("exporter") != exporter), "kept")
            # The copies of a flow may lie in both tables.
            marked = cut(promoted(_union([f.withColumn("_table", F.lit(t)) for t, f in kept.items()])), "promoted")
            for table in kept:
                own_rows = marked.where((F.col("_table") == table) & F.concat(F.lit("date="), F.col("date").cast("string"), F.lit("/hour="), F.col("hour").cast("string")).isin(sorted(touched)))
                changes += self._replaced(table, own_rows.drop("_table", "date", "hour"), {p: v for p, v in span[table].items() if p in touched})
            changes += self._rebuilt(marked.drop("_table", "date", "hour"), begin, end, marks)
        for table, gone in (("r_ts_if", own), ("r_dim_if", own), ("r_dim", marks), ("ifc", F.col("exporter") == exporter)):
            done = {p for t, p, _, _ in changes if t == table}
            changes += self._without(table, gone, done)
        self._change(changes)
        return len(touched)

    def _without(self, table: str, gone: Column, done: set[str]) -> list[Change]:
        parts = self._parts(table, lambda p: p not in done)
        if not parts:
            return []
        days = {f"date={r.date}" for r in self._frame(table, parts).where(gone).select("date").distinct().collect()}
        old = {p: v for p, v in parts.items() if p in days}
        return self._replaced(table, self._frame(table, old).where(~F.coalesce(gone, F.lit(False))).drop("date"), old) if old else []

    def _rebuilt(self, flows: DataFrame, a: datetime, b: datetime, gone: Column | None = None) -> list[Change]:
        """r_ts, r_host and r_dim of [a, b) from the flow rows of that span; the rest of its days stays, as do marks of sampled
        interfaces but for those in gone."""
        changes: list[Change] = []
        inside = (F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))
        for name in ("r_ts", "r_host", "r_dim"):
            new = rollups.ALL[name](flows)
            old = self._parts(name, lambda p: a.date() <= _begin(p).date() <= b.date())
            if old:
                keep = ~inside
                if name == "r_dim":
                    keep = keep | F.col("dim").isin("obsif", "obsunk")
                    keep = keep if gone is None else keep & ~F.coalesce(gone, F.lit(False))
                new = _union([self._frame(name, old).where(keep).drop("date"), new])
            changes += self._replaced(name, new, old)
        return changes

    def rebuild(self, start: datetime, end: datetime) -> None:
        """Make r_ts, r_host and r_dim of [start, end) anew from the flow rows, keeping the marks of sampled interfaces.

        Whole days are replaced at a time: the rest of their rows is kept as it is.
        """
        a, b = utc(start), utc(end)
        self._change(self._rebuilt(cut(self.flows(a, b).drop("date", "hour"), "rebuilding"), a, b))

    def build_views(self) -> None:
        """Make the summaries by device and interface for all sealed rows."""
        flows = self.read("flows")
        changes: list[Change] = []
        for name in ("r_ts_if", "r_dim_if"):
            changes += self._replaced(name, rollups.ALL[name](flows), self._parts(name))
        self._change(changes)

    # -- questions about the store
    def exporters(self, limit: int = 200) -> DataFrame:
        """exporter, wire, rows, first, last; the busiest."""
        g = self.flows().groupBy("exporter").agg(F.sum("wire").alias("wire"), F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        return g.orderBy(F.desc("wire"), "exporter").limit(limit)

    def usage(self) -> dict[str, int]:
        """Bytes of each table's files."""
        fs = self.commits.fs()
        return {t: sum(fs.getContentSummary(self.commits.path(f"{t}/version={v}/{p}")).getLength() for p, vs in self._parts(t).items() for v in vs) for t in TABLES if self.exists(t)}

    def data_start(self) -> datetime | None:
        """When the stored flow rows begin: only their first partitions are looked at."""
        parts = [(_begin(p), t, p, v) for t in ("flows", "hot") for p, v in self._parts(t).items()]
        first = min((x[0] for x in parts), default=None)
        if first is None:
            return None
        return _union([self._frame(t, {p: v}).select("ts") for at, t, p, v in parts if at == first]).agg(F.min("ts")).first()[0]

    def projection(self, days: int = DETAIL_DAYS) -> dict[str, float]:
        """Bytes of detail a day so far, and what the retention of that many days will come to."""
        span = self.flows().agg(((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 86_400).alias("d")).first().d or 0
        size = sum(v for k, v in self.usage().items() if k in ("flows", "hot"))
        per = size / max(span, 1 / 24)
        return {"per_day": per, "retained": per * days}


def repaired(df: DataFrame) -> DataFrame:
    """Counters that wrapped below zero as 0."""
    return df.withColumns({c: F.when(F.col(c) > rollups.WRAPPED, F.lit(0)).otherwise(F.col(c)) for c in rollups.SUMS if c in df.columns})


def counters_csv(hours: DataFrame, path: str) -> None:
    """Hourly counters as CSV with a header and average rates in bits per second; text in UTF-8 (a byte-order mark is put on
    by whoever hands the file out)."""
    rate = lambda c: F.round(F.col(c) * 8 / 3600).cast("long").alias(c.replace("oct", "bps"))
    shown = hours.select(F.date_format(F.timestamp_seconds("start"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"), "exporter", "ifindex", "in_oct", "out_oct", "in_pkts", "out_pkts", rate("in_oct"), rate("out_oct"))
    shown.orderBy("start", "exporter", "ifindex").write.mode("overwrite").option("header", "true").csv(path)
