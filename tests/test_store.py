"""Sealing, retention, purging, rebuilding; and streams against batches."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from flows import T0, flow_rows, records
from pyspark.sql import functions as F

from netloom.core import shared
from netloom.core.commits import Commits
from netloom.maintain import store
from netloom.maintain.store import Store
from netloom.operators import ingest, interfaces, rollups, totals
from netloom.plans.tables import Tables
from netloom.plans.query import Query, utc
from netloom.sources import netflow, udp
from netloom.streaming import ingest as streaming

SUMS = ["bytes", "wire", "pkts", "flows"]


def sample(spark, n=30):
    rows = [dict(start=600 * m, end=600 * m, exporter=e, src_port=40000 + m % 7, dst_port=[443, 53][m % 2], proto=[6, 17][m % 3 == 0]) for m in range(n) for e in ("10.9.9.1", "10.9.9.2")]
    return flow_rows(spark, rows).drop("domain", "observation", "direction", "arrival_seq")


def filled(spark, tmp_path, n=30):
    s, flows = Store(spark, str(tmp_path / "data")), sample(spark, n)
    s.append("hot", flows)
    for name in ("r_ts", "r_host", "r_dim"):
        s.append(name, rollups.ALL[name](flows))
    s.append("r_dim", rollups.observed(flows))
    return s, flows


def same(a, b, keys):
    total = lambda df: sorted(map(tuple, df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS]).collect()))
    return total(a) == total(b)


KEYS = {"r_ts": ["ts", "app"], "r_host": ["ts", "ip", "role", "internal"], "r_dim": ["ts", "dim", "val"]}


def test_seal_keeps_every_row(spark, tmp_path):
    s, flows = filled(spark, tmp_path)
    now = T0 + timedelta(hours=3, minutes=4)
    assert s.seal(now) == 2 and s.seal(now) == 0  # the hour that ended four minutes ago waits
    assert s.read("flows").count() == 24 and s.flows().count() == 60
    late = flows.where(F.col("ts") < F.lit(T0 + timedelta(minutes=30)))
    s.append("hot", late)
    assert s.seal(T0 + timedelta(days=1)) == 4 and s.flows().count() == 66
    assert same(s.read("r_ts_if"), rollups.r_ts_if(s.flows()), ["ts", "iface", "side", "app"])
    assert s.data_start() == T0.replace(tzinfo=None) and s.usage()["flows"] > 0 and s.projection()["per_day"] > 0
    assert s.read("flows", T0, T0 + timedelta(hours=1)).count() == 18
    assert [r.exporter for r in s.exporters().collect()] == ["10.9.9.1", "10.9.9.2"]


def test_retention_and_purge(spark, tmp_path):
    s, flows = filled(spark, tmp_path)
    s.seal(T0 + timedelta(days=1))
    assert s.retain(T0 + timedelta(days=20))["flows"] == 0
    assert s.purge_size(T0 + timedelta(minutes=90)).where("table = 'flows'").first().rows == 18
    s.purge(T0 + timedelta(minutes=90))
    assert s.flows().count() == 42 and s.flows().agg(F.min("ts")).first()[0] == (T0 + timedelta(minutes=90)).replace(tzinfo=None)
    assert s.read("r_ts").agg(F.min("ts")).first()[0] == (T0 + timedelta(minutes=90)).replace(tzinfo=None)
    dropped = s.retain(T0 + timedelta(days=40))
    assert dropped["flows"] == 4 and dropped["r_ts"] == 0
    s.purge()
    assert not s.exists("flows") and not s.exists("r_dim")


@pytest.mark.parametrize("step", ["_written", "commit", "delete"])
def test_an_operation_that_stops_changes_all_or_nothing(spark, tmp_path, monkeypatch, step):
    s, flows = filled(spark, tmp_path, 8)

    def stop(*a):
        raise OSError("stopped")

    fs = s.commits.fs()

    class Stopping:
        def __getattr__(self, name):
            return stop if name == "delete" else getattr(fs, name)

    operations = [lambda: s.seal(T0 + timedelta(hours=9)), lambda: s.purge_exporter("10.9.9.1"), lambda: s.build_views()]
    for operate in operations:
        before = {t: s.read(t).count() for t in store.TABLES if s.exists(t)}
        with monkeypatch.context() as m:
            if step == "_written":
                real, calls = Store._written, []
                m.setattr(Store, "_written", lambda self, t, df: (calls.append(t), real(self, t, df) if len(calls) < 2 else stop())[1])
            elif step == "commit":
                m.setattr(Commits, "commit", stop)
            else:
                m.setattr(Commits, "fs", lambda self: Stopping())
            with pytest.raises(OSError):
                operate()
        if step != "delete":
            assert {t: s.read(t).count() for t in store.TABLES if s.exists(t)} == before
        operate()
        left = s.flows()
        assert same(s.read("r_ts_if"), rollups.r_ts_if(s.read("flows")), ["ts", "iface", "side", "app"])
        assert left.count() == left.distinct().count()
    assert s.flows().count() == 8 and s.sweep() > 0 and s.flows().count() == 8


def test_rows_that_arrive_while_an_hour_is_sealed_stay(spark, tmp_path, monkeypatch):
    s, flows = filled(spark, tmp_path, 8)
    late, real = flows.where(F.col("ts") < F.lit(T0 + timedelta(minutes=30))), Store._replaced

    def replaced(self, *a):
        monkeypatch.undo()
        self.append("hot", late)
        return real(self, *a)

    monkeypatch.setattr(Store, "_replaced", replaced)
    s.seal(T0 + timedelta(days=1))
    assert s.read("flows").count() == 16 and s.read("hot").count() == 6
    s.seal(T0 + timedelta(days=1))
    assert s.read("flows").count() == 22 and not s.exists("hot")


def test_many_small_versions_are_put_together(spark, tmp_path):
    s = Store(spark, str(tmp_path / "d"))
    rows = rollups.r_ts(sample(spark))
    for _ in range(4):
        s.append("r_ts", rows)
    assert s.compact(T0 + timedelta(days=2), most=3) == 1 and s.compact(T0 + timedelta(days=2), most=3) == 0
    assert s.read("r_ts").count() == 4 * rows.count() and [len(v) for v in s._state()["r_ts"].values()] == [1]


def test_stored_tables_answer_without_a_search_for_copies(spark, tmp_path):
    s, flows = filled(spark, tmp_path)
    s.seal(T0 + timedelta(days=1))
    t = s.tables()
    q = Query(T0, T0 + timedelta(hours=2))
    plan = totals.totals(t, q)._jdf.queryExecution().executedPlan().toString()
    assert "arrival_seq" not in plan and totals.totals(t, q).first().flows == 12 and utc(t.data_from) == T0


def test_rebuild_equals_what_was_built(spark, tmp_path):
    s, flows = filled(spark, tmp_path)
    before = {n: spark.createDataFrame(s.read(n).drop("date").collect(), s.read(n).drop("date").schema) for n in KEYS}
    s.seal(T0 + timedelta(days=1))
    s.rebuild(T0 + timedelta(hours=1), T0 + timedelta(hours=3))
    for n, keys in KEYS.items():
        assert same(s.read(n), before[n], keys)


def test_purge_of_an_exporter_promotes_the_other_copies(spark, tmp_path):
    s, flows = filled(spark, tmp_path)
    s.seal(T0 + timedelta(hours=3))
    assert flows.where("dup").count() == 30
    assert s.purge_exporter("10.9.9.1") == 5
    left = s.flows()
    assert left.count() == 30 and left.where("dup").count() == 0 and left.where("exporter = '10.9.9.1'").count() == 0
    for n, keys in KEYS.items():
        own = s.read(n).where("dim not in ('obsif', 'obsunk')") if n == "r_dim" else s.read(n)
        assert same(own, rollups.ALL[n](left), keys)
    assert {r.val for r in s.read("r_dim").where("dim = 'obsif'").collect()} == {"10.9.9.2/1"}


def test_promotion(spark):
    rows = flow_rows(spark, [dict(exporter=f"10.9.9.{k}") for k in (1, 2, 3)])
    assert [r.dup for r in store.promoted(rows.where("exporter <> '10.9.9.1'")).orderBy("exporter").collect()] == [False, True]
    assert [r.dup for r in store.promoted(rows).orderBy("exporter").collect()] == [False, True, True]


def test_format_repair_and_csv(spark, tmp_path):
    s = Store(spark, str(tmp_path / "d"))
    s.check_format()
    (tmp_path / "d" / "FORMAT.json").write_text('{"version": 9}')
    (tmp_path / "d" / ".FORMAT.json.crc").unlink(missing_ok=True)
    with pytest.raises(RuntimeError):
        s.check_format()
    fixed = store.repaired(spark.createDataFrame([(2**62 + 1, 5)], "wire long, pkts long")).first()
    assert (fixed.wire, fixed.pkts) == (0, 5)
    ifc = spark.createDataFrame([(T0 + timedelta(minutes=m), "10.9.9.9", 1, 0, 4500 * m, 0, 0, 0, T0) for m in (0, 30, 59)], "ts timestamp, exporter string, ifindex long, speed long, in_oct long, out_oct long, in_pkts long, out_pkts long, arrived timestamp")
    hours = interfaces.interface_hours(Tables(sample(spark), ifc=ifc), Query(T0, T0 + timedelta(hours=1)))
    store.counters_csv(hours, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv")).splitlines()
    assert text[0].startswith("start,exporter") and text[1] == "2026-03-10T10:00:00Z,10.9.9.9,1,265500,0,0,0,590,0"


# -- streams
def landed(spark, folder, df, files=3):
    df.repartition(files).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_of_records_is_the_batch(spark, tmp_path):
    rows = [dict(start=60 * m, end=60 * m + 90, src_port=40000 + m % 5, bytes=1000 + m) for m in range(40)]
    recs = records(spark, rows)
    sink = streaming.Sink(spark, str(tmp_path / "out"))
    q = streaming.run(landed(spark, tmp_path / "in", recs), sink, str(tmp_path / "cp"), trigger={"availableNow": True})
    q.awaitTermination(120)
    want = ingest.flow_rows(recs, datetime.now(timezone.utc))
    cols = ["ts", "sport", "bytes", "wire", "pkts", "flows"]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert key(sink.read("hot")) == key(want)
    for n, keys in KEYS.items():
        own = sink.read(n).where("dim not in ('obsif', 'obsunk')") if n == "r_dim" else sink.read(n)
        assert same(own, rollups.ALL[n](want), keys)
    sink.write(ingest.flow_rows(recs, datetime.now(timezone.utc)), 0)  # a batch that is run again replaces itself
    assert sink.read("hot").where("true").count() >= want.count()


def test_stream_marks_duplicates_across_batches_and_leaves_no_tables(spark, tmp_path):
    rows = [dict(start=60 * m, end=60 * m, exporter=e, arrival_seq=2 * m + i) for i, e in enumerate(("10.9.9.1", "10.9.9.2")) for m in range(6)]
    rows += [dict(start=0, end=0, exporter="10.9.9.2", bytes=1 << 50, arrival_seq=99)]  # not plausible
    recs = records(spark, rows).withColumn("arrived", F.col("end") + F.expr("interval 1 minute"))
    sink, shared_tables = streaming.Sink(spark, str(tmp_path / "out")), lambda: sorted(os.listdir(shared.shared_folder(spark).removeprefix("file://")))
    shared.cut(recs, "there")
    before = shared_tables()
    q = streaming.run(landed(spark, tmp_path / "in", recs, 1), sink, str(tmp_path / "cp"), trigger={"availableNow": True})
    q.awaitTermination(300)
    got = sink.read("hot").groupBy("exporter", "dup").count().collect()
    assert {(r.exporter, r.dup): r["count"] for r in got} == {("10.9.9.1", False): 6, ("10.9.9.2", True): 6}
    assert {(r.exporter, r.what): r.n for r in sink.read("health").groupBy("exporter", "what").agg(F.sum("n").alias("n")).collect()} == {("10.9.9.2", "refused"): 1}
    assert shared_tables() == before


def test_stream_of_sflow(spark, tmp_path):
    from test_sources import sflow_counter, sflow_datagram, sflow_sample

    now = datetime.now(timezone.utc)
    raws = [sflow_datagram(sflow_sample(), sflow_counter()), sflow_datagram(sflow_sample(seq=2), seq=2), sflow_datagram(sflow_sample(), sflow_counter()), b"\0\0\0\5broken"]
    for i, raw in enumerate(raws):
        spark.createDataFrame([(bytearray(raw), "10.9.9.9", now + timedelta(seconds=i), i)], udp.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = streaming.Sink(spark, str(tmp_path / "out"))
    streaming.run_sflow(udp.stream(spark, str(tmp_path / "in"), 1), sink, str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination(300)
    assert sorted((r.wire, r.pkts, r.flows) for r in sink.read("hot").collect()) == [(100_000, 100, 1)] * 2
    assert sink.read("ifc").count() == 1 and [(r.what, r.n) for r in sink.read("health").collect()] == [("unreadable", 1)]


def test_session_raises_counts_by_what_was_lost_and_gives_up_sets():
    from test_sources import FIELDS, data, message, template

    session, got = netflow.Session(), []
    session.take(message(template(300, *FIELDS), seq=0), "e", 0.0)
    for k in range(1, 2400):
        if k % 20:  # one in twenty is lost
            got += session.take(message(data(300, *[("10.0.0.1", 100, 1)] * 20), seq=k), "e", k / 10)
    got += session._rated([], 1e6)
    late = [r["mult"] for r in got if r["arrived"] > 61]
    assert all(abs(m / (20 / 19) - 1) < 0.015 for m in late) and late
    session.take(message(data(301, ("10.0.0.1", 100, 1)), seq=2400), "e", 240.0)
    out = session.take(message(template(302, *FIELDS), seq=2401), "e", 240.0 + netflow.HOLD_S)
    assert [r["error"] for r in out if "error" in r] == ["no template 301 came"] and not session.sets


def test_stream_duplicates(spark, tmp_path):
    rows = [dict(start=60 * m, end=60 * m, exporter=e, arrival_seq=2 * m + i) for m in range(6) for i, e in enumerate(("10.9.9.1", "10.9.9.2"))]
    flows = flow_rows(spark, rows, dedup=False).withColumn("arrived", F.when(F.minute("ts") == 3, F.col("ts") + F.expr("interval 20 minutes")).otherwise(F.col("ts") + F.expr("interval 1 minute")))
    q = streaming.marked(landed(spark, tmp_path / "in", flows, 1)).writeStream.format("memory").queryName("marked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.exporter, r.ts.minute): r.dup for r in spark.table("marked").collect()}
    assert got == {(e, m): e == "10.9.9.2" and m != 3 for e in ("10.9.9.1", "10.9.9.2") for m in range(6)}


def test_stream_of_datagrams_keeps_templates(spark, tmp_path):
    from test_sources import FIELDS, data, message, options, template

    opt, rate = options(400, 10)
    raws = [message(data(300, ("10.0.0.1", 100, 1))), message(template(300, *FIELDS)), message(data(300, ("10.0.0.2", 200, 2))), message(opt, rate)]
    now = datetime.now(timezone.utc)
    for i, raw in enumerate(raws):  # a file and so a batch for each
        spark.createDataFrame([(bytearray(raw), "10.9.9.9", now + timedelta(seconds=i), i)], udp.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = streaming.decoded(udp.stream(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()  # its timers would keep it going
    got = streaming.as_records(spark.table("records")).orderBy("bytes").collect()
    assert [(r.src, r.bytes, r.sampling, r.sampling_known) for r in got] == [("10.0.0.1", 100, 10, True), ("10.0.0.2", 200, 10, True)]


def test_watermarked_totals(spark, tmp_path):
    flows = sample(spark)
    q = streaming.minute_totals(landed(spark, tmp_path / "in", flows, 1), "1 minute").writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = spark.table("totals"), rollups.r_ts(flows).where(F.col("ts") < flows.agg(F.max("ts")).first()[0])
    assert sorted(map(tuple, got.select("ts", "app", "wire").collect())) == sorted(map(tuple, want.select("ts", "app", "wire").collect()))


def test_landing_datagrams(spark, tmp_path):
    import socket
    import time

    sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    sock.bind(("127.0.0.1", 0))
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for k in range(5):
        out.sendto(b"\0\5" + bytes([k]), sock.getsockname())
    assert udp.land(sock, str(tmp_path / "a"), seconds=0.2, until=time.time() + 0.6) == 5
    df = spark.read.schema(udp.SCHEMA).parquet(str(tmp_path / "a"))
    assert df.count() == 5 and df.select("arrival_seq").distinct().count() == 5
    out.sendto(b"x", sock.getsockname())
    assert udp.land(sock, str(tmp_path / "b"), frozenset({"127.0.0.1"}), 0.1, time.time() + 0.3) == 0
    assert netflow.records(df).count() == 0
