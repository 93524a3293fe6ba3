"""Rules: what must fire and what must not; findings merged over time."""

from datetime import timedelta

from flows import T0, flow_rows

from netloom.detect import findings, rules
from netloom.detect.rules import Limits

END = T0 + timedelta(minutes=10)


def fired(spark, rule, rows, limits=Limits(), end=END, **more):
    flows = flow_rows(spark, rows)
    return rule(rules.windowed(flows, limits, end - timedelta(seconds=1), end), limits, **more).collect()


def probe(k, **more):
    return dict(start=60, end=60, dst=f"10.2.{k // 250}.{k % 250 + 1}", dst_port=445, src_port=40000 + k, bytes=40, packets=1, tcp_flags=2) | more


def test_scan(spark):
    (f,) = fired(spark, rules.scan, [probe(k) for k in range(60)])
    assert (f.sev, f.src, f.port, f.targets, len(f.examples)) == (3, "10.0.0.1", "445/tcp", 60, 6)
    assert not fired(spark, rules.scan, [probe(k) for k in range(49)])
    assert not fired(spark, rules.scan, [probe(k, bytes=900) for k in range(60)])
    assert not fired(spark, rules.scan, [probe(k, packets=5, bytes=200) for k in range(60)])  # too many packets a host
    assert len(fired(spark, rules.scan, [probe(k, mult=1000.0) for k in range(6)])) == 1
    (f,) = fired(spark, rules.scan, [probe(k, src="203.0.113.5", proto=1, src_port=0, dst_port=2048, bytes=84) for k in range(60)])
    assert (f.sev, f.port) == (1, "icmp")


def test_portscan_and_brute(spark):
    rows = [probe(0, dst_port=20 + k) for k in range(40)]
    (f,) = fired(spark, rules.portscan, rows)
    assert f.ports == 40 and f.examples == [str(20 + k) for k in range(8)]
    assert not fired(spark, rules.portscan, [probe(0, dst_port=40000 + k) for k in range(40)])
    rows = [probe(0, dst_port=22, src_port=30000 + k, bytes=1500, packets=10) for k in range(35)]
    (f,) = fired(spark, rules.brute, rows)
    assert (f.conns, f.port) == (35, "22/tcp") and not fired(spark, rules.brute, rows[:29])


def test_fastscan(spark):
    rows = [probe(h, dst_port=100 + p, src_port=20000 + 100 * h + p, bytes=42) for h in range(50) for p in range(12)]
    (f,) = fired(spark, rules.fastscan, rows)
    assert (f.sev, f.targets, f.ports) == (3, 50, 12)


def checkins(minutes, size=900):
    return [dict(start=60 * m, end=60 * m, bytes=size, packets=1, src_port=40000 + m) for m in minutes]


def test_beacon(spark):
    end = T0 + timedelta(minutes=20)
    wide = Limits(window=1200)
    (f,) = fired(spark, rules.beacon, checkins(range(0, 16, 2)), wide, end)
    assert (f.period_s, f.jitter, f.checkins) == (120, 0, 8)
    assert not fired(spark, rules.beacon, checkins([0, 1, 5, 6, 7, 13, 14, 19]), wide, end)
    assert not fired(spark, rules.beacon, checkins(range(0, 16, 2), 90_000), wide, end)


def session(src, dst, minute, port=22):
    return dict(start=60 * minute, end=60 * minute, src=src, dst=dst, dst_port=port, src_port=50000, bytes=5000, packets=10)


def test_lateral_and_chain(spark):
    hops = [session("10.0.0.1", "10.0.0.2", 1), session("10.0.0.2", "10.0.0.3", 2)]
    assert {(f.src, f.port, tuple(f.targets)) for f in fired(spark, rules.lateral, hops)} == {("10.0.0.1", "22/tcp", ("10.0.0.2",)), ("10.0.0.2", "22/tcp", ("10.0.0.3",))}
    (f,) = fired(spark, rules.chain, hops)
    assert (f.src, f.via, f.dst, f.onward) == ("10.0.0.2", "10.0.0.2", "10.0.0.3", 1)
    assert not fired(spark, rules.chain, [session("10.0.0.1", "10.0.0.2", 2), session("10.0.0.2", "10.0.0.3", 1)])
    many = [session(f"10.0.1.{k}", "10.0.0.2", 1, 445) for k in range(8)] + [session("10.0.0.2", f"10.0.2.{k}", 2, 445) for k in range(8)]
    assert {f.src for f in fired(spark, rules.chain, many)} == set()  # a new server, not an intruder
    old = spark.createDataFrame([("svc", "10.0.0.2", "", 22, T0 - timedelta(days=9), T0)], rules.SEEN)
    assert {f.src for f in fired(spark, rules.lateral, hops, seen=old)} == {"10.0.0.2"} and not fired(spark, rules.chain, hops, seen=old)
    middle = [session(f"10.0.1.{k}", "10.0.0.2", 1) for k in range(3)] + [session("10.0.0.2", f"10.0.2.{k}", 2) for k in range(3)]
    (f,) = fired(spark, rules.chain, middle)
    assert f.onward == 3 and getattr(f, "from") == ["10.0.1.0", "10.0.1.1", "10.0.1.2"]


def test_exfil_flood_threat_and_model_api(spark):
    up = [dict(bytes=200_000_000, packets=150_000)]
    (f,) = fired(spark, rules.exfil, up)
    assert f.dst == "192.0.2.7" and f.up > 2e8
    known = spark.createDataFrame([("up", "10.0.0.1", "192.0.2.7", 0, T0 - timedelta(days=3), T0)], rules.SEEN)
    assert not fired(spark, rules.exfil, up, seen=known)
    assert not fired(spark, rules.exfil, up + [dict(src="192.0.2.7", dst="10.0.0.1", src_port=443, dst_port=50000, bytes=100_000_000, packets=90_000)])
    (f,) = fired(spark, rules.flood, [dict(src=f"203.0.113.{k}", dst="10.0.0.9", bytes=60 * 700_000, packets=700_000, src_port=5000 + k, dst_port=80) for k in range(20)])
    assert (f.dst, f.port, f.sources) == ("10.0.0.9", "80/tcp", 20) and f.pps >= 20_000
    asns = spark.createDataFrame([("4c0000200", "4c00002ff", 0, 1, "US", "OpenAI, L.L.C."), ("4c6336400", "4c63364ff", 0, 2, "US", "Other")], "lo string, hi string, source int, asn long, cc string, org string")
    threats = spark.createDataFrame([("4c0000207", "4c0000207", 0, 0, "bad")], "lo string, hi string, ordinal int, len int, list string")
    flows = flow_rows(spark, [dict(bytes=4_000_000, packets=4000), dict(dst="198.51.100.9", bytes=4_000_000, packets=4000)], asns=asns, threats=threats)
    rows = rules.windowed(flows, Limits(), END - timedelta(seconds=1), END)
    (f,) = rules.model_api(rows, Limits(model_orgs=("openai", "example model maker"))).collect()
    assert (f.sev, f.dst) == (1, "192.0.2.7") and rules.model_api(rows, Limits(model_orgs=())).count() == 0
    (f,) = rules.threat(rows, Limits()).collect()
    assert (f.sev, f.port) == (3, "bad")


def test_findings_keep_all_threats_of_a_window(spark):
    threats = spark.createDataFrame([("4c0000207", "4c0000207", 0, 0, "bad")], "lo string, hi string, ordinal int, len int, list string")
    flows = flow_rows(spark, [dict(start=60, end=60, src=f"10.1.{k // 250}.{k % 250 + 1}") for k in range(510)], threats=threats)
    got = findings.run(flows, END - timedelta(seconds=1), END, learned=False).where("kind = 'threat'").collect()
    assert {r.src for r in got} == {f"10.1.{k // 250}.{k % 250 + 1}" for k in range(510)}
    rows = rules.windowed(flows, Limits(), END - timedelta(seconds=1), END)
    assert rules.threat(rows, Limits()).count() == 510 and rules.threat(rows, Limits(most={"threat": 500})).count() == 500


def test_windows_overlap(spark):
    flows = flow_rows(spark, [dict(start=0, end=0), dict(start=299, end=299, src_port=2), dict(start=300, end=300, src_port=3)])
    rows = rules.windowed(flows, Limits(), T0 - timedelta(hours=1), T0 + timedelta(hours=1)).groupBy("win").count().collect()
    base = int(T0.timestamp())
    assert {(r.win - base, r["count"]) for r in rows} == {(300, 2), (600, 3), (900, 1)}


def test_findings_merge(spark):
    rows = [probe(k, start=60 * m, end=60 * m, src_port=40000 + 100 * m + k) for m in (1, 4, 7, 12, 80) for k in range(60)]
    flows = flow_rows(spark, rows)
    found = findings.merge(None, findings.run(flows, T0, T0 + timedelta(hours=2))).where("kind = 'scan'").orderBy("first").collect()
    assert [(f.hits, f.status) for f in found] == [(4, "open"), (2, "open")]
    import json

    assert json.loads(found[0].ev)["targets"] == 60 and len(json.loads(found[0].ev)["examples"]) == 6
    kept = spark.createDataFrame([tuple(f) for f in found], findings.FINDING)
    false = findings.with_status(kept, kept.limit(1), "false")
    again = findings.merge(false, findings.run(flows, T0, T0 + timedelta(hours=2)))
    assert again.where("kind = 'scan' and hits > 2").count() == 1 and again.where("status = 'false'").count() == 1 and again.where("kind = 'scan' and status = 'open' and hits <> 2").count() == 0
    assert findings.select(kept, T0, T0 + timedelta(minutes=20)).count() == 1
    assert findings.select(kept, T0, T0 + timedelta(hours=3), ip="10.2.0.1").count() == 2 and findings.select(kept, T0, T0 + timedelta(hours=3), status="done").count() == 0


def test_evidence(spark):
    s = [("k", "a", "b", "p", 1, T0, T0, 1, '{"n":5,"l":["b","a"],"t":"x"}', "open", 1), ("k", "a", "b", "p", 3, T0, T0 + timedelta(minutes=1), 1, '{"n":2.5,"l":["c"],"t":"y"}', "open", 2)]
    df = spark.createDataFrame([(r[10], "k", r[4], "a", "b", "p", r[5], r[6], r[8]) for r in s], "win long, kind string, sev int, src string, dst string, port string, first timestamp, last timestamp, ev string")
    (f,) = findings.merge(None, df).collect()
    import json

    assert json.loads(f.ev) == {"n": 5, "l": ["a", "b", "c"], "t": "y"} and f.sev == 3 and f.hits == 2
    assert findings.merge(None, df.limit(0)).count() == 0


def test_learning(spark):
    flows = flow_rows(spark, [session("10.0.0.1", "10.0.0.2", 1), dict(bytes=2_000_000, packets=2000)])
    rows = rules.windowed(flows, Limits(), T0, END)
    old = spark.createDataFrame([("svc", "10.0.0.2", "", 22, T0 - timedelta(days=9), T0 - timedelta(days=8)), ("up", "x", "y", 0, T0 - timedelta(days=99), T0 - timedelta(days=60))], rules.SEEN)
    got = {(r.kind, r.a, r.b, r.port) for r in rules.learn(old, rows).collect()}
    assert got == {("svc", "10.0.0.2", "", 22), ("up", "10.0.0.1", "192.0.2.7", 0)}
