"""Per-minute totals that are corrected while late records arrive, up to a cut-off.

Each batch of arrivals is appended to the retained raw rows.  The periods it touches are computed anew from all retained
rows of those periods, written beside the earlier version, and become visible together when the commit of the batch appears.
A commit is one small file that holds the whole state: which version of each period is current and where its raw rows lie.
Commits are numbered in the order they were made, whatever the batches are called, so reading looks at the last one only; a
batch that died leaves no trace, and one that is run again replaces its own files.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netloom.core.columns import floor_div, micros
from netloom.core.commits import Commits
from netloom.core.deliveries import first_deliveries

MINUTE_US = 60_000_000
MEASURES = ["bytes", "wire", "pkts", "flows"]
RAW = "ts timestamp, app string, bytes long, wire long, pkts long, flows long, dup boolean, arrival_seq long, arrived timestamp"
COLUMNS = [c.split()[0] for c in RAW.split(", ")]
TOTALS = "minute_us long, app string, bytes long, wire long, pkts long, flows long, records long"
#: A period's raw rows are put together when they lie in more folders than this.
PARTS = 16


@dataclass
class State:
    """One commit.  applied: the batches taken in, as closed spans of numbers; closed_us: periods that end before it take no
    more rows; refused: rows that came for such a period; current, raw: of each period the folder of its totals (none where
    no row counts) and those of its raw rows."""

    seq: int = 0
    applied: list[list[int]] = field(default_factory=list)
    closed_us: int | None = None
    refused: int = 0
    current: dict[str, str] = field(default_factory=dict)
    raw: dict[str, list[str]] = field(default_factory=dict)

    def has(self, batch: int) -> bool:
        return any(a <= batch <= b for a, b in self.applied)

    def add(self, batch: int) -> None:
        spans: list[list[int]] = []
        for a, b in sorted([*self.applied, [batch, batch]]):
            if spans and a <= spans[-1][1] + 1:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        self.applied = spans


class LateTotals:
    """Totals per minute and app under one folder; one writer at a time.

    late_us: rows that arrived more than this after their ts are left out; early_us: so are rows whose ts is more than
    this after their arrival.  period_us: size of the unit that is recomputed.
    """

    def __init__(self, spark: SparkSession, folder: str, late_us: int = 120 * MINUTE_US, early_us: int = 2 * MINUTE_US, period_us: int = 60 * MINUTE_US):
        self.spark, self.folder, self.late_us, self.early_us, self.period_us = spark, folder.rstrip("/"), late_us, early_us, period_us
        self.commits = Commits(spark, folder)

    # -- files
    def _periods(self, folder: str) -> list[str]:
        return [n.removeprefix("period=") for n in self.commits.names(folder) if n.startswith("period=")]

    def state(self) -> State:
        held = self.commits.last()[1]
        return State(**held) if held else State()

    def _commit(self, state: State) -> None:
        if not self.commits.commit(state.seq, asdict(state)):
            raise OSError(f"commit {state.seq} could not be made; is there another writer?")

    # -- batches
    def _delay(self) -> Column:
        return micros(F.col("arrived")) - micros(F.col("ts"))

    def apply(self, rows: DataFrame, batch: int) -> list[int]:
        """Take in one batch of arrivals, in any order of batches; the periods it touched. A batch that was taken in before
        does nothing.

        Rows without ts or arrived and rows past the cut-off touch no period and aren't retained: whatever of their record
        came earlier decides.  Rows for a period that forget() has closed are counted as refused.
        """
        state = self.state()
        if state.has(batch):
            return []
        state.seq += 1
        own = f"{state.seq:012d}"
        kept = rows.where(F.col("ts").isNotNull() & (self._delay() <= self.late_us)).select(*COLUMNS, floor_div(micros(F.col("ts")), self.period_us).alias("period"))
        if state.closed_us is not None:
            first_open = F.timestamp_micros(F.lit(state.closed_us // self.period_us * self.period_us))
            state.refused += kept.where(F.col("ts") < first_open).count()
            kept = kept.where(F.col("ts") >= first_open)
        # Few files: rows of a period come together, a large period in several tasks.
        kept.hint("rebalance", "period").write.mode("overwrite").partitionBy("period").parquet(f"{self.folder}/raw/{own}")
        periods = self._periods(f"raw/{own}")
        for p in periods:
            state.raw.setdefault(p, []).append(own)
        crowded = [p for p in periods if len(state.raw[p]) > PARTS]
        if crowded:
            self._raw(state, crowded).hint("rebalance", "period").write.mode("overwrite").partitionBy("period").parquet(f"{self.folder}/raw/{own}-whole")
            state.raw |= {p: [f"{own}-whole"] for p in crowded}
        if periods:
            totals = self.totals(self._raw(state, periods)).withColumn("period", floor_div(F.col("minute_us"), self.period_us))
            totals.write.mode("overwrite").partitionBy("period").parquet(f"{self.folder}/totals/{own}")
            counted = set(self._periods(f"totals/{own}"))
            state.current = {p: v for p, v in state.current.items() if p not in periods} | {p: own for p in periods if p in counted}
        state.add(batch)
        self._commit(state)
        return sorted(map(int, periods))

    def _raw(self, state: State, periods: list[str]) -> DataFrame:
        paths = [f"{self.folder}/raw/{part}/period={p}" for p in periods for part in state.raw[p]]
        return self.spark.read.schema(RAW).parquet(*paths).withColumn("period", floor_div(micros(F.col("ts")), self.period_us))

    def totals(self, raw: DataFrame) -> DataFrame:
        """minute_us, app and sums of the rows that count; second deliveries once, the first one deciding."""
        counts = ~F.col("dup") & (self._delay() <= self.late_us) & (self._delay() >= -self.early_us)
        return (
            first_deliveries(raw).where(counts)
            .groupBy(floor_div(micros(F.col("ts")), MINUTE_US).alias("minute"), "app")
            .agg(*[F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in MEASURES], F.count("*").alias("records"))
            .select((F.col("minute") * MINUTE_US).alias("minute_us"), "app", *MEASURES, "records")
        )

    # -- results
    def read(self) -> DataFrame:
        """The current totals: of every period the version of the last commit that touched it."""
        paths = [f"{self.folder}/totals/{v}/period={p}" for p, v in self.state().current.items()]
        return self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)

    def forget(self, before_us: int) -> None:
        """Close the periods that end at before_us or earlier (choose it late enough for their cut-off to have passed): their
        totals stay as they are and their raw rows go, as do superseded versions.

        What is to stay is committed before anything is deleted.
        """
        state = self.state()
        state.seq += 1
        state.closed_us = max(before_us, state.closed_us or before_us)
        state.raw = {p: parts for p, parts in state.raw.items() if (int(p) + 1) * self.period_us > state.closed_us}
        self._commit(state)
        fs = self.commits.fs()
        wanted = {f"totals/{v}/period={p}" for p, v in state.current.items()} | {f"raw/{part}/period={p}" for p, parts in state.raw.items() for part in parts}
        for kind in ("raw", "totals"):
            for version in self.commits.names(kind):
                inside = [f"{kind}/{version}/period={p}" for p in self._periods(f"{kind}/{version}")]
                if not wanted & set(inside):
                    fs.delete(self.commits.path(f"{kind}/{version}"), True)
                    continue
                for name in set(inside) - wanted:
                    fs.delete(self.commits.path(name), True)


def replay(hot: DataFrame, totals: LateTotals, batches: int = 4) -> LateTotals:
    """Bring a whole table in as batches, in order of arrival: equal spans of arrival time, rows without one in the last."""
    at = micros(F.col("arrived"))
    first, last = hot.agg(F.min("arrived"), F.max("arrived")).select(*[micros(F.col(c)) for c in ("min(arrived)", "max(arrived)")]).first()
    if first is None:
        totals.apply(hot, 0)
        return totals
    width = (last - first) // batches + 1
    for b in range(batches):
        low, high = (F.timestamp_micros(F.lit(first + k * width)) for k in (b, b + 1))
        inside = (F.col("arrived") >= low) & (F.col("arrived") < high)
        totals.apply(hot.where(inside if b < batches - 1 else (at >= first + b * width) | F.col("arrived").isNull()), b)
    return totals


def stored_totals(r_ts: DataFrame) -> DataFrame:
    """minute_us, app, stored: wire of the partial rows, second deliveries once; rows without ts belong to no minute."""
    rows = first_deliveries(r_ts.select("ts", "app", "wire", "arrival_seq", "arrived")).where(F.col("ts").isNotNull())
    return (
        rows.groupBy(floor_div(micros(F.col("ts")), MINUTE_US).alias("minute"), "app").agg(F.sum(F.coalesce(F.col("wire"), F.lit(0))).alias("stored"))
        .select((F.col("minute") * MINUTE_US).alias("minute_us"), "app", "stored")
    )


def disagreements(corrected: DataFrame, r_ts: DataFrame) -> DataFrame:
    """ts_s, app, wire, stored of the minutes whose stored total isn't the corrected one; an absent total is 0."""
    a, b = corrected.select("minute_us", "app", "wire").alias("a"), stored_totals(r_ts).alias("b")
    same = (F.col("a.minute_us") == F.col("b.minute_us")) & F.col("a.app").eqNullSafe(F.col("b.app"))
    wire, stored = F.coalesce("a.wire", F.lit(0)), F.coalesce("b.stored", F.lit(0))
    return a.join(b, same, "full").where(wire != stored).select(
        (F.coalesce("a.minute_us", "b.minute_us") / 1_000_000).cast("long").alias("ts_s"), F.coalesce("a.app", "b.app").alias("app"), wire.alias("wire"), stored.alias("stored")
    )
