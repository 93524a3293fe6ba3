"""Ingest, queries and summaries on literal cases, and summaries against detail."""

from datetime import datetime, timedelta, timezone
from random import Random

import pytest
from flows import T0, flow_rows, records
from pyspark.sql import functions as F

from netloom.detect import findings
from netloom.functions import net
from netloom.functions.flow import total, unsigned_sum
from netloom.operators import ingest, interfaces, overview, paths, ranges, rollups, series, topn, totals
from netloom.plans import query
from netloom.plans.query import Filter, Query
from netloom.plans.tables import BOTH, DEVICE, IN, OUT, Tables, blanked_flows, clean_flows, view_of

NOW = datetime(2026, 7, 1, tzinfo=timezone.utc)


def slices(spark, start, end, amount=100):
    df = records(spark, [dict(start=start, end=end, bytes=amount)])
    return [(int((r.ts.replace(tzinfo=timezone.utc) - T0).total_seconds()), r.bytes, r.flows) for r in ingest.minute_slices(df.withColumn("t", F.col("bytes").cast("double")).drop("bytes"), NOW, {"t": "bytes"}).orderBy("ts").collect()]


def test_minute_slices(spark):
    assert slices(spark, 30, 120, 90) == [(0, 30, 0), (60, 60, 1)]
    assert slices(spark, 30, 30) == [(0, 100, 1)] and slices(spark, None, 30) == [(0, 100, 1)] and slices(spark, 90, 30) == [(0, 100, 1)]
    got = slices(spark, 7, 59 * 60 + 13, 10)  # fewer bytes than minutes
    assert sum(b for _, b, _ in got) == 10 and min(b for _, b, _ in got) >= 0 and [f for _, _, f in got] == [0] * 59 + [1]
    got = slices(spark, 0, 7 * 3600, 3600)  # too long: the last hour
    assert len(got) == 60 and got[0][0] == 6 * 3600 and sum(b for _, b, _ in got) == 3600
    assert slices(spark, 0, 60) == [(0, 100, 1)]


def test_implausible_records(spark):
    bad = [dict(end=datetime(1985, 1, 1)), dict(start=datetime(2031, 1, 1)), dict(mult=2.0**25), dict(bytes=2**46, mult=2.0), dict(packets=2**46, mult=2.0), dict(bytes=(512 << 10) * 11, packets=10), dict(src="nowhere"), dict(dst=None)]
    assert [r.arrival_seq for r in records(spark, [*bad, {}, dict(mult=0.0, packets=None, bytes=None)]).where(F.coalesce(ingest.plausible(NOW), F.lit(False))).collect()] == [8, 9]


def test_layers(spark):
    rows = [dict(bytes=1482 * 100, packets=100, mult=10.0), dict(bytes=1500, packets=10, l2=True), dict(bytes=1500, packets=10, l2=True, vlan=5), dict(bytes=1500, packets=10, l2=True, l2_hdr=22), dict(bytes=1000, packets=10, vlan=5), dict(bytes=10, packets=10, l2=True)]
    got = [(r.l3, r.wire, r.pkts) for r in ingest.normalised(records(spark, rows)).orderBy("arrival_seq").collect()]
    assert got == [(1482000, 1000 * 1500, 1000), (1320, 1500, 10), (1280, 1500, 10), (1240, 1500, 10), (1000, 1220, 10), (0, 10, 10)]


def test_roles(spark):
    cases = [
        (dict(opener=1, src_port=443, dst_port=50000), True), (dict(opener=-1), False), (dict(packets=1, tcp_flags=0x02, src_port=443, dst_port=50000), True), (dict(packets=1, tcp_flags=0x12), False),
        (dict(packets=2, tcp_flags=0x12), True), (dict(src_port=443, dst_port=50000), False), (dict(src_port=7777, dst_port=7777), True), (dict(src_port=7000, dst_port=9001), False), (dict(src_port=9001, dst_port=7000), True),
        (dict(proto=17, src_port=53, dst_port=50000), False), (dict(proto=1, src_port=1, dst_port=9), True), (dict(proto=132, src_port=1, dst_port=9), False),
    ]
    got = records(spark, [c for c, _ in cases]).withColumn("c", net.source_is_client()).orderBy("arrival_seq").collect()
    assert [r.c for r in got] == [c for _, c in cases]
    apps = spark.createDataFrame([(6, 443), (17, 443), (6, 8081), (132, 5), (1, 0), (200, 0)], "p int, s int").select(net.app_name(F.col("p"), F.col("s")).alias("a")).collect()
    assert [r.a for r in apps] == ["HTTPS", "QUIC", "TCP/8081", "SCTP/5", "ICMP", "200"]


def test_address_keys(spark):
    import ipaddress

    given = ["10.0.0.1", "255.255.255.255", "::", "::1", "2001:db8::5", "fe80:1:2:3:4:5:6:7", "1::", "not", "1.2.3", "1::2::3", "", None]
    got = [r.k for r in spark.createDataFrame([(a,) for a in given], "a string").select(net.address_key(F.col("a")).alias("k")).collect()]

    def key(a):
        try:
            x = ipaddress.ip_address(a)
            return f"{x.version}{int(x):0{8 if x.version == 4 else 32}x}"
        except ValueError:
            return None

    assert got[:9] == [key(a) for a in given[:9]] and got[10:] == [None, None]


def test_enrichment(spark):
    nets = ranges.networks(spark, [("198.51.100.0/24", "branch"), ("10.0.0.0/16", "office")], "name string")
    asns = spark.createDataFrame([("4c0000200", "4c00002ff", 0, 64501, "DE", "Ex"), ("4cb007100", "4cb0071ff", 1, 64502, "JP", "Low")], "lo string, hi string, source int, asn long, cc string, org string")
    threats = spark.createDataFrame([("4c0000207", "4c0000207", 0, 0, "bad")], "lo string, hi string, ordinal int, len int, list string")
    rows = [{}, dict(src="203.0.113.9", dst="10.0.5.5", src_port=60000, dst_port=22), dict(dst="198.51.100.3"), dict(src="8.8.8.8", dst="9.9.9.9", dst_as=77), dict(src="2001:db8::1", dst="fd00::1")]
    got = flow_rows(spark, rows, nets=nets, asns=asns, threats=threats).orderBy("arrival_seq").collect()
    assert [(r.dir, r.peer_asn, r.peer_cc, r.segment, r.threat) for r in got] == [
        (1, 64501, "DE", "office", "bad"), (2, 64502, "JP", "office", ""), (3, 0, "", "office", ""), (4, 77, "", "8.8.8.0/24", ""), (2, 0, "", "fd00::/48", ""),
    ]
    assert got[0].cli4 == 167772161 and got[4].cli4 == 0 and (got[0].cli_int, got[0].srv_int) == (True, False)


def test_duplicates(spark):
    rows = [dict(exporter="10.9.9.1"), dict(exporter="10.9.9.2"), dict(exporter="10.9.9.1"), dict(exporter="10.9.9.2", end=3600, start=3600), dict(exporter="10.9.9.1", observation=5)]
    assert [r.dup for r in flow_rows(spark, rows).orderBy("arrival_seq").collect()] == [False, True, False, False, True]
    late = flow_rows(spark, rows, dedup=False).withColumn("arrived", F.col("ts") + F.expr("interval 20 minutes"))
    assert not any(r.dup for r in ingest.mark_duplicates(late, timedelta(minutes=8)).collect())


def test_settle_and_clock(spark):
    df = records(spark, [dict(bytes=97), dict(bytes=3, start=-100)]).withColumn("arrived", F.lit(T0 + timedelta(seconds=4)))
    assert ingest.settle_seconds(df).first().seconds == 6 and ingest.settle_seconds(df.limit(0)).count() == 0
    odd = records(spark, [dict(start=590, end=600), dict(start=-5 * 3600 - 10, end=-5 * 3600), dict(start=-10, end=0)]).withColumn("arrived", F.lit(T0))
    got = [(r.start.replace(tzinfo=timezone.utc) - T0).total_seconds() for r in ingest.corrected_times(odd).orderBy("arrival_seq").collect()]
    assert got == [-10, -10, -10]


def test_ingest_of_two_exporters(spark):
    rows = [dict(start=60 * m, end=60 * m + 59, bytes=1482 * 100, packets=100, mult=10.0, exporter=e) for m in range(120) for e in ("10.9.9.1", "10.9.9.2")]
    flows = flow_rows(spark, rows)
    assert flows.where("dup").count() == 120
    q = Query(T0, T0 + timedelta(hours=3))
    t = totals.totals(Tables(flows), q).first()
    assert (t.wire, t.flows, t.hosts, t.peers) == (120 * 1000 * 1500, 120, 1, 1)
    top = topn.top_n(Tables(flows), q, "conv").collect()
    assert len(top) == 1 and top[0].key3 == "443/tcp" and flows.where("app <> 'HTTPS'").count() == 0
    assert totals.totals(Tables(flows), q.also(Filter("exporter", "10.9.9.2"))).first().flows == 120


def rankings(spark):
    rows = []
    for h in range(8):
        rows.append(dict(start=3600 * h, end=3600 * h, dst="192.0.2.1", bytes=100 * 1500, packets=100))
        rows += [dict(start=3600 * h, end=3600 * h, dst="192.0.2.2", src_port=40000 + k, bytes=100 * 40, packets=100) for k in range(5)]
    return flow_rows(spark, rows)


def test_rankings_on_both_paths(spark):
    flows = rankings(spark)
    q = Query(T0, T0 + timedelta(hours=8))
    for t in (Tables(flows), Tables(flows, rollups.r_ts(flows), rollups.r_host(flows), rollups.r_dim(flows))):
        first = lambda by, asc=False: topn.top_n(t, q, "server", by=by, asc=asc).first().key  # noqa: E731, B023
        assert [first("wire"), first("pkts"), first("flows"), first("avg", True), first("avg")] == ["192.0.2.1", "192.0.2.2", "192.0.2.2", "192.0.2.2", "192.0.2.1"]
        with pytest.raises(ValueError):
            topn.top_n(t, q, "server", by="size")
    with pytest.raises(ValueError):
        topn.top_n(Tables(flows), q, "planet")


def test_summaries_answer_as_detail(spark):
    rng, rows = Random(1), []
    for m in range(0, 720, 7):
        for e in ("10.9.9.1", "10.9.9.2"):
            for _ in range(2):
                src = rng.choice(["10.0.0.1", "10.0.0.2", "2001:db8::7", "10.1.1.1"])
                rows.append(dict(start=60 * m, end=60 * m, src=src, dst=rng.choice(["192.0.2.1", "10.3.3.3", "2001:db8::9"]), dst_port=rng.choice([443, 53, 8081]), proto=rng.choice([6, 17]), exporter=e, in_if=rng.randint(0, 3), out_if=rng.randint(0, 3), src_port=rng.randint(40000, 40003)))
    flows = flow_rows(spark, rows).cache()
    detail = Tables(flows)
    summed = Tables(flows, *[rollups.ALL[n](flows) for n in ("r_ts", "r_host", "r_dim", "r_ts_if", "r_dim_if")])
    start, end = T0, T0 + timedelta(hours=12)
    for filters in ((), (Filter("exporter", "10.9.9.2"),), (Filter("iface", "10.9.9.1/2"),), (Filter("iface_in", "10.9.9.1/1"),), (Filter("exporter", "10.9.9.1"), Filter("iface_out", "10.9.9.1/3"))):
        q = Query(start, end, filters)
        assert summed.rollup(q, "r_ts") is not None
        a, b = (totals.totals(t, q).select("bytes", "wire", "pkts", "flows").first() for t in (detail, summed))
        assert a == b and a.flows > 0
        for dim in ("app", "port", "proto", "dir", "country", "segment"):
            rows_ = [sorted((r.key, r.wire, r.flows) for r in topn.top_n(t, q, dim).collect()) for t in (detail, summed)]
            assert rows_[0] == rows_[1]
        lines = [sorted(map(tuple, series.series_by(t, q, "app", now=NOW).collect())) for t in (detail, summed)]
        assert lines[0] == lines[1]
    assert summed.rollup(Query(start, start + timedelta(hours=6)), "r_ts") is None
    assert summed.rollup(Query(start, end, (Filter("app", "DNS"),)), "r_ts") is None
    assert summed.rollup(Query(start, end, (Filter("exporter", "10.9.9.1"),)), "r_host") is None


def test_views():
    q = lambda *f: view_of(Query(T0, T0 + timedelta(days=1), tuple(Filter(*x) for x in f)))
    assert q() == view_of(Query(T0, T0)) and q().key == ""
    assert (q(("exporter", "e")).key, q(("exporter", "e")).sides) == ("e", (DEVICE,))
    assert q(("iface", "e/1")).sides == (IN, OUT, BOTH) and q(("iface_in", "e/1"), ("iface_out", "e/1")).sides == (BOTH,)
    assert q(("exporter", "f"), ("iface", "e/1")) is None and q(("app", "x")) is None and q(("exporter", "e", True)) is None and q(("iface", "e/1"), ("iface", "e/2")) is None


def test_ranges_steps_and_buckets():
    h = timedelta(hours=1)
    assert query.step_for(h) == timedelta(minutes=1) and query.step_for(6 * h) == timedelta(minutes=5) and query.step_for(timedelta(days=400)) == timedelta(days=1)
    now = datetime(2026, 3, 10, 12, 34, tzinfo=timezone.utc)
    assert query.parse(now).start == datetime(2026, 3, 9, 12, tzinfo=timezone.utc) and query.parse(now, "6h").start == now - 6 * h
    with pytest.raises(ValueError):
        query.parse(now, "2h")
    with pytest.raises(ValueError):
        query.parse(now, start_ms=5, end_ms=5)
    q = query.parse(now, start_ms=int(T0.timestamp() * 1000) + 1000, end_ms=int(T0.timestamp() * 1000) + 8 * 3600_000 + 1, zone_minutes=540)
    assert q.start == T0 and q.end == T0 + 9 * h and q.offset == 9 * h
    assert query.parse(now, zone_minutes=9999).offset == timedelta()
    five = timedelta(minutes=5)
    assert query.bucket_seconds(T0, 0, five, T0 + h, T0 + timedelta(minutes=2), NOW) == 180
    assert query.bucket_seconds(T0, 0, timedelta(minutes=1), T0 + timedelta(seconds=30), None, NOW) == 60  # a past minute counts whole
    assert query.bucket_seconds(T0, 0, timedelta(minutes=1), T0 + timedelta(seconds=30), None, T0 + timedelta(seconds=31)) == 30
    assert query.bucket_count(T0, T0 + timedelta(minutes=5, seconds=14), five) == 1 and query.bucket_count(T0, T0 + timedelta(minutes=5, seconds=15), five) == 2
    assert query.trunc(datetime(2026, 3, 4, 2), 6 * h, 9 * h) == datetime(2026, 3, 3, 21, tzinfo=timezone.utc)
    assert query.settled_to(T0, NOW, five, False) == T0 and query.settled_to(NOW, NOW, timedelta(minutes=1), True) == NOW - timedelta(minutes=2)


def test_a_local_day_is_one_column(spark):
    day = datetime(2026, 3, 3, 15, tzinfo=timezone.utc)
    flows = flow_rows(spark, [dict(start=day + timedelta(hours=h), end=day + timedelta(hours=h)) for h in range(24)], now=NOW)
    q = Query(day, day + timedelta(days=200), offset=timedelta(hours=9))
    got = series.series_by(Tables(flows), q.also(Filter("vlan", "9", True)), "app", now=NOW).collect()
    assert len(got) == 1 and got[0].bucket == int(day.timestamp())


def test_filters_refuse(spark):
    for f in (Filter("planet", "x"), Filter("port", "http"), Filter("ip", "2001:db8::/32"), Filter("dir", "up"), Filter("bytes", "both"), Filter("iface", "10.0.0.1"), Filter("iface", "10.0.0.1/x"), Filter("asn", "x"), Filter("src", "x"), Filter("proto", "x")):
        with pytest.raises(ValueError):
            query.condition(f)
    with pytest.raises(ValueError):
        Query(T0, T0, tuple(Filter("app", "x") for _ in range(21)))


def test_rings_and_remainder(spark):
    rows = [dict(src="10.1.1.1", dst="198.51.100.1", bytes=9000, packets=0), dict(src="10.1.1.2", dst="198.51.100.1", bytes=3000, packets=0), dict(src="10.1.1.2", dst="198.51.100.2", bytes=1000, packets=0)]
    q = Query(T0, T0 + timedelta(hours=1))
    got = {(r.level, r.parent, r.key): r.wire for r in paths.rings(Tables(flow_rows(spark, rows)), q, "server", "client", 1, 1).collect()}
    assert got == {(1, "", "198.51.100.1"): 12000, (1, "", "__other__"): 1000, (2, "198.51.100.1", "10.1.1.1"): 9000, (2, "198.51.100.1", "__other__"): 3000, (2, "__other__", "__other__"): 1000}
    with pytest.raises(ValueError):
        paths.rings(Tables(flow_rows(spark, rows)), q, "server", "server")


def test_as_zero_is_kept(spark):
    flows = flow_rows(spark, [dict(start=60 * m, end=60 * m, dst_as=64501 if m % 3 == 0 else 0) for m in range(30)])
    got = series.series_by(Tables(flows), Query(T0, T0 + timedelta(minutes=30)), "asn_dst", now=NOW).collect()
    assert {r.name for r in got} == {"0\t", "64501\t"} and len({r.bucket for r in got}) == 30


def ifc(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(minutes=m), "10.9.9.9", i, 8_000_000, a, b, 0, 0, T0 + timedelta(minutes=m)) for m, i, a, b in rows], "ts timestamp, exporter string, ifindex long, speed long, in_oct long, out_oct long, in_pkts long, out_pkts long, arrived timestamp")


def test_counter_hours(spark):
    rows = [(30, 1, 1000, 0), (50, 1, 2200, 0), (70, 1, 3400, 0), (150, 1, 9000, 0), (160, 1, 100, 0), (170, 1, 700, 0)]
    t = Tables(flow_rows(spark, [{}]), ifc=ifc(spark, rows))
    got = {(r.start - int(T0.timestamp())) // 3600: r.in_oct for r in interfaces.interface_hours(t, Query(T0, T0 + timedelta(hours=3))).collect()}
    assert got == {0: 1800, 1: 600, 2: 600}
    clipped = interfaces.interface_hours(t, Query(T0 + timedelta(minutes=45), T0 + timedelta(hours=1))).collect()
    assert [r.in_oct for r in clipped] == [900]


def test_a_side_without_flows(spark):
    rows = [(m, 2, 1000 * m, 2000 * m) for m in range(0, 70)]
    flows = flow_rows(spark, [dict(start=60 * m, end=60 * m, in_if=1, out_if=2) for m in range(60)])
    r = interfaces.recon(Tables(flows, ifc=ifc(spark, rows)), Query(T0, T0 + timedelta(hours=1)), "10.9.9.9", 2).first()
    assert (r.in_no_flow, r.out_no_flow) == (True, False) and r.in_dev == -1.0


def test_peers_of_interfaces(spark):
    rows = [dict(exporter="10.9.9.1", in_if=1, out_if=k, observation=1) for k in (2, 3, 4)] + [dict(exporter="10.9.9.2", in_if=1, out_if=k, observation=0, direction=255, src_port=9000 + k) for k in (2, 3)] + [dict(exporter="10.9.9.3", in_if=k, out_if=k + 5, observation=0, direction=255, src_port=9100 + k) for k in (1, 2)]
    flows = flow_rows(spark, rows)
    marks = rollups.r_dim(flows).unionByName(rollups.observed(flows))
    got = {(r.exporter, r.ifindex): r.peer for r in interfaces.interfaces(Tables(flows, r_dim=marks, ifc=ifc(spark, [])), Query(T0, T0 + timedelta(hours=1))).collect()}
    assert {k: v for k, v in got.items() if k[0] == "10.9.9.1"} == {("10.9.9.1", 1): False, ("10.9.9.1", 2): True, ("10.9.9.1", 3): True, ("10.9.9.1", 4): True}
    assert {k: v for k, v in got.items() if k[0] == "10.9.9.2"} == {("10.9.9.2", 1): False, ("10.9.9.2", 2): True, ("10.9.9.2", 3): True}  # one carries it all
    assert not any(v for k, v in got.items() if k[0] == "10.9.9.3")  # can't be told


def test_report_prefers_counters(spark):
    rows = [(m, 2, 60_000_000 // 60 * m, 60_000_000 // 60 * m) for m in range(0, 70)]
    flows = flow_rows(spark, [dict(start=60 * m, end=60 * m, in_if=1, out_if=2, bytes=10_000 * (10 if m == 30 else 1), packets=0) for m in range(60)])
    q = Query(T0, T0 + timedelta(hours=1))
    t = Tables(flows, ifc=ifc(spark, rows))
    got = {r.ifindex: r for r in interfaces.report_interfaces(t, q).collect()}
    assert (got[1].source, got[2].source) == ("flows", "counters") and abs(got[2].in95 - 1_000_000 * 8 / 60) < 1 and 1.6 < got[2].util95 < 1.7
    assert got[1].in_peak > got[1].in95 > 0 and abs(got[1].in_avg - 69 * 10_000 * 8 / 3600) < 1e-6
    head = overview.report_head(t, q, NOW).first()
    assert head.wire == 69 * 10_000 and head.peak_bps > head.p95_bps


def test_sums_saturate(spark):
    df = spark.createDataFrame([(2**62,)] * 9, "v long")
    r = df.agg(unsigned_sum("v").alias("u"), total("v").alias("t")).first()
    assert int(r.u) == 2**64 - 1 and r.t == 2**63 - 1
    assert df.limit(0).agg(total("v").alias("t")).first().t == 0


def test_queries_on_nothing(spark):
    empty = Tables(flow_rows(spark, [{}]).limit(0), ifc=ifc(spark, []))
    q = Query(T0, T0 + timedelta(hours=1))
    assert topn.top_n(empty, q, "client").count() == 0 and totals.totals(empty, q).first().wire == 0 and series.series_by(empty, q, "client", now=NOW).count() == 0
    assert paths.sankey(empty, q).count() == 0 and interfaces.interfaces(empty, q).count() == 0 and overview.shares(empty, q, "dir", 4).count() == 0
    assert series.total_series(empty, q, NOW).count() == 60


def test_conditions_reach_the_scan_below_the_search_for_copies(spark, tmp_path):
    rows = flow_rows(spark, [dict(start=60 * i, end=60 * i + 30, src_port=50000 + i) for i in range(10)])
    hot = rows.withColumn("arrived", F.col("ts")).unionByName(rows.withColumn("arrived", F.col("ts") + F.expr("interval 1 hour")))
    hot.write.parquet(f"{tmp_path}/hot.parquet")
    t = Tables(blanked_flows(spark.read.parquet(f"{tmp_path}/hot.parquet")))
    q = Query(T0 + timedelta(minutes=2), T0 + timedelta(minutes=5))
    assert totals.totals(t, q).first().flows == 3 and t.rows().count() == 10
    plan = topn.top_n(t, q, "app")._jdf.queryExecution().executedPlan().toString()
    pushed = [x for x in plan.split("\n") if "PushedFilters" in x]
    assert pushed and all("GreaterThanOrEqual(ts," in x and "LessThan(ts," in x for x in pushed)
    plan = clean_flows(spark.read.parquet(f"{tmp_path}/hot.parquet")).where(q.in_range())._jdf.queryExecution().executedPlan().toString()
    assert all("GreaterThanOrEqual(ts," in x for x in plan.split("\n") if "PushedFilters" in x)


def test_report_and_first_page_are_composed(spark):
    rows = [dict(start=60 * m, end=60 * m, src_port=40000 + m, in_if=1 + m % 2, out_if=3, bytes=1000 * (m + 1)) for m in range(20)]
    flows = flow_rows(spark, rows)
    ifc = spark.createDataFrame([], "ts timestamp, exporter string, ifindex long, speed long, in_oct long, out_oct long, in_pkts long, out_pkts long")
    t, q = Tables(flows, ifc=ifc), Query(T0, T0 + timedelta(hours=1))
    found = spark.createDataFrame([("scan", "10.0.0.1", "", "22/tcp", 3, T0, T0, 1, "{}", "open"), ("scan", "10.0.0.2", "", "22/tcp", 1, T0 - timedelta(days=9), T0 - timedelta(days=8), 1, "{}", "open")], findings.FINDING)
    parts = overview.report(t, q, found, now=NOW)
    assert {r.severity: r.n for r in parts["findings_by_severity"].collect()} == {"high": 1, "medium": 0, "low": 0} and parts["findings"].count() == 1
    assert parts["head"].first().wire == sum(1000 * (m + 1) + 180 for m in range(20)) and parts["interfaces"].count() == 3 and parts["top_app"].first().key == "HTTPS"
    one = overview.report(t, q.also(Filter("iface", "10.9.9.9/1")), now=NOW)
    assert [(r.ifindex, r.in_wire) for r in one["interfaces"].collect()] == [(1, one["head"].first().wire)]
    page = overview.overview(t, q, T0 + timedelta(minutes=20, seconds=30))
    assert page["rate"].first().now_bps == sum(1000 * (m + 1) + 180 for m in range(15, 20)) * 8 / 300 and all(f.count() >= 0 for f in page.values())
