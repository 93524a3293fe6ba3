"""Structured Streaming: the batch transforms over micro-batches, duplicates with state, partial summaries per batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netloom.core.commits import Commits
from netloom.core.shared import cut, scope
from netloom.operators import ingest, rollups
from netloom.operators.ingest import FLOW_KEY, POINT
from netloom.sources import netflow, sflow

#: How far back in data time reports of a minute are compared.
WINDOW = timedelta(minutes=8)
ARRIVAL_DELAY = "10 minutes"


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """Text as ordinary objects, which every version of the Arrow bridge takes."""
    return df.astype({c: object for c in df.columns if isinstance(df[c].dtype, pd.StringDtype)})


def marked(rows: DataFrame, window: timedelta = WINDOW) -> DataFrame:
    """dup for a stream of rows (ts, the flow's key, the reporting point, arrival_seq, arrived).

    Rows that arrive more than the window after their minute are compared with nothing and pass by the state as no
    duplicates: a stateful operator would drop them.  So do rows over an hour ahead of their arrival, which would move the
    watermark past everyone else's.  A key is one flow in one minute; its state is the point that reported it first.
    """
    late = F.unix_micros("arrived") - F.unix_micros("ts") - 60_000_000
    inside = (late <= int(window.total_seconds() * 1e6)) & (late >= -3_600_000_000)
    schema = rows.drop("dup").schema.add("dup", "boolean")
    names = schema.fieldNames()
    points = POINT

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        df = pd.concat(list(frames)).sort_values("arrival_seq")  # the reports of one flow in one minute
        seen = [tuple(None if pd.isna(x) else x for x in r) for r in df[points].itertuples(index=False)]
        origin = pickle.loads(state.get[0]) if state.exists else seen[0]
        if not state.exists:
            state.update((pickle.dumps(origin),))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + int(window.total_seconds() * 1000) + 1)
        df["dup"] = [s != origin for s in seen]
        yield plain(df[names])

    timed = rows.drop("dup").where(inside).withWatermark("ts", f"{int(window.total_seconds())} seconds")
    kept = timed.groupBy(*FLOW_KEY).applyInPandasWithState(first, schema, "origin binary", "append", GroupStateTimeout.EventTimeTimeout)
    aside = rows.drop("dup").where(F.coalesce(~inside, F.lit(True))).withColumn("dup", F.lit(False))
    return kept.unionByName(aside.select(*names))


def decoded(datagrams: DataFrame) -> DataFrame:
    """Records of version 5, 9 and IPFIX datagrams, with the state of each exporter kept between batches; and rows that have
    only an error for what couldn't be read.

    Sets wait for their template and records for their rate, five minutes at most by the arrival of datagrams, which the
    receiver stamps; receivers may lie ARRIVAL_DELAY apart.  A device's domains lend each other their rates, so a device is
    one key: its templates, rates and whatever waits are one state.
    """
    names = [c.split()[0] for c in STREAMED.split(", ")]

    def take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = pickle.loads(state.get[0]) if state.exists else netflow.Session()
        rows = []
        if state.hasTimedOut:
            rows = [r | {"exporter": key[0]} for r in session._rated([], state.getCurrentWatermarkMs() / 1000)]
        else:
            for df in frames:
                for raw, arrived, seq in df.sort_values("arrival_seq")[["payload", "arrived", "arrival_seq"]].itertuples(index=False):
                    try:
                        got = session.take(bytes(raw), key[0], arrived.timestamp())
                    except Exception as e:  # a hostile datagram must not end the stream
                        got = [{"error": str(e)[:200], "arrived": arrived.timestamp()}]
                    rows += [{"exporter": key[0]} | r | {"arrival_seq": seq * netflow.NUMBERS + k} for k, r in enumerate(got)]
        state.update((pickle.dumps(session),))
        if session.waiting or session.sets:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + netflow.HOLD_S * 1000 + 1)
        out = pd.DataFrame(rows, columns=names).astype(object)
        out = out.where(out.notna(), None)
        out["arrived"] = pd.to_datetime(out["arrived"].astype(float), unit="s", utc=True).dt.tz_localize(None).astype("datetime64[us]")
        out["arrival_seq"] = out["arrival_seq"].fillna(0)
        yield plain(out)

    timed = datagrams.withWatermark("arrived", ARRIVAL_DELAY)
    return timed.groupBy("exporter").applyInPandasWithState(take, STREAMED, "session binary", "append", GroupStateTimeout.EventTimeTimeout)


def once(datagrams: DataFrame, within: str = "1 minute") -> DataFrame:
    """Datagrams that came twice once: equal in sender and content, within so much time of arrival."""
    timed = datagrams.withColumn("_crc", F.xxhash64("payload")).withWatermark("arrived", within)
    return timed.dropDuplicatesWithinWatermark(["exporter", "_crc"]).drop("_crc")


STREAMED = (
    "start_ms long, end_ms long, src string, dst string, src_port int, dst_port int, proto short, tcp_flags short, tos short, bytes long, packets long, in_if long, out_if long, vlan int, encap short, direction short, "
    "src_as long, dst_as long, exporter string, domain long, source short, sampling long, mult double, sampling_known boolean, arrived timestamp, arrival_seq long, error string"
)


def as_records(rows: DataFrame) -> DataFrame:
    """decoded() in the columns of operators.ingest.RECORD; rows with an error stay, their other columns null."""
    return rows.select(
        F.timestamp_millis("start_ms").alias("start"), F.timestamp_millis("end_ms").alias("end"),
        *[x.split()[0] for x in STREAMED.split(", ")[2:]], F.lit(False).alias("l2"), F.lit(0).cast("short").alias("l2_hdr"), F.lit(0).cast("short").alias("opener"), F.lit(0).cast("long").alias("observation"),
    )


class Sink:
    """Writes each batch's rows and partial summaries once: every batch has folders of its own, so a batch that is run again
    replaces what it wrote before.

    Beside them it keeps the origins of flows (see ingest.mark_against), of which a batch reads those of the one before and
    writes its own, and per batch and exporter what was refused or couldn't be read.
    """

    KEPT = 3  # batches whose origins stay, for batches that are run again

    def __init__(self, spark: SparkSession, folder: str, window: timedelta = WINDOW):
        self.spark, self.folder, self.window = spark, folder.rstrip("/"), window
        self.commits = Commits(spark, folder)

    def _origins(self, batch: int) -> DataFrame | None:
        had = sorted(int(n.removeprefix("batch=")) for n in self.commits.names("origins") if n.startswith("batch="))
        for old in had[: -self.KEPT]:
            self.commits.fs().delete(self.commits.path(f"origins/batch={old}"), True)
        before = [b for b in had if b < batch]
        return self.spark.read.parquet(f"{self.folder}/origins/batch={before[-1]}") if before else None

    def take(self, rows: DataFrame, batch: int) -> None:
        """write() of rows whose duplicates are marked against this batch and the ones before."""
        rows, origins = ingest.mark_against(cut(rows, "batch"), self._origins(batch), self.window)
        origins.write.mode("overwrite").parquet(f"{self.folder}/origins/batch={batch}")
        self.write(rows, batch)

    def write(self, rows: DataFrame, batch: int) -> None:
        rows = cut(rows, "rows")
        rows.write.mode("overwrite").parquet(f"{self.folder}/hot/batch={batch}")
        for name in ("r_ts", "r_host", "r_dim"):
            part = rollups.ALL[name](rows)
            if name == "r_dim" and "obs_if" in rows.columns:
                part = part.unionByName(rollups.observed(rows))
            part.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def note(self, table: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}").drop("batch")


def _taken(records: DataFrame, sink: Sink, n: int, nets: DataFrame | None, asns: DataFrame | None, threats: DataFrame | None) -> None:
    """One batch of records into the sink, and what of it was refused or unreadable."""
    now, records = datetime.now(timezone.utc), cut(records, "records")
    good = records.where("error is null").drop("error") if "error" in records.columns else records
    health = ingest.refused(good, now).select("exporter", F.lit("refused").alias("what"), "n")
    if "error" in records.columns:
        health = health.unionByName(records.where("error is not null").groupBy("exporter", F.lit("unreadable").alias("what")).agg(F.count("*").alias("n")))
    sink.note("health", health, n)
    sink.take(ingest.flow_rows(good, now, nets, asns, threats, dedup=False), n)


def run(records: DataFrame, sink: Sink, checkpoint: str, nets: DataFrame | None = None, asns: DataFrame | None = None, threats: DataFrame | None = None, trigger: dict | None = None):
    """Start the stream from records to flow rows and summaries.

    Records become rows in each micro-batch's plan, so the look-ups are ordinary joins with tables that may change between
    batches; tables that a batch shares go when it ends.  Clocks are corrected by the arrival and duplicates marked across
    batches.  Records that are implausible or have an error are counted in the sink's table health.
    """

    def batch(df: DataFrame, n: int) -> None:
        with scope(sink.spark):
            _taken(df, sink, n, nets, asns, threats)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def run_sflow(datagrams: DataFrame, sink: Sink, checkpoint: str, nets: DataFrame | None = None, asns: DataFrame | None = None, threats: DataFrame | None = None, trigger: dict | None = None):
    """Start the stream from sFlow datagrams to flow rows, summaries and interface counters (the sink's table ifc).

    Datagrams that came twice count once, also across batches.  Rates are raised by what sequence numbers show as lost in
    windows of 30 seconds inside a batch, so batches should hold several of them.
    """

    def batch(df: DataFrame, n: int) -> None:
        with scope(sink.spark):
            samples = cut(sflow.once(sflow.samples(df)), "samples")
            sink.note("ifc", sflow.counters(samples), n)
            broken = samples.where("kind = 'error'").select(F.coalesce("agent", F.lit("")).alias("exporter"), F.coalesce("error", F.lit("")).alias("error"), "arrived")
            _taken(sflow.records(samples).unionByName(broken, allowMissingColumns=True), sink, n, nets, asns, threats)

    return once(datagrams).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def minute_totals(rows: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Sums per minute and app of a stream of rows; a minute is given out when the watermark has passed it."""
    timed = rows.where("not dup").withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", "1 minute"), "app").agg(*[F.sum(c).alias(c) for c in rollups.SUMS]).select(F.col("window.start").alias("ts"), "app", *rollups.SUMS)
