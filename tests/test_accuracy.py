"""What is estimated from samples and losses, against what was sent."""

from datetime import datetime, timedelta, timezone
from random import Random

from pyspark.sql import functions as F

from netloom.sources import encode, netflow, sflow

T0 = datetime(2026, 3, 10, 12, 0, tzinfo=timezone.utc)
FLOW = dict(src="10.0.0.1", dst="192.0.2.7", src_port=50000, dst_port=443, proto=6, tcp_flags=0, bytes=0, packets=1, in_if=3, out_if=7, vlan=0, start_ms=0, end_ms=0)


def grams(spark, rows):
    """rows: (seconds after T0, payload), in order of arrival."""
    full = [(bytearray(raw), "10.9.9.9", T0 + timedelta(seconds=s), i) for i, (s, raw) in enumerate(rows)]
    return spark.createDataFrame(full, "payload binary, exporter string, arrived timestamp, arrival_seq long")


def test_sflow_with_lost_datagrams(spark):
    rng, sent, rows = Random(20), 0, []
    for k in range(6_000):  # ten minutes of 60 million packets, one in a thousand sampled
        lengths = [rng.randint(64, 1500) for _ in range(10)]
        sent += 1000 * sum(lengths)
        samples = [encode.flow_sample(FLOW, n, 1000, seq=10 * k + j, pool=1000 * (10 * k + j)) for j, n in enumerate(lengths)]
        if rng.random() >= 0.03:
            rows.append((k / 10, encode.sflow("10.9.9.9", samples, seq=k)))
    got = sflow.records(sflow.once(sflow.samples(grams(spark, rows)))).agg(F.sum(F.col("bytes") * F.col("mult"))).first()[0]
    assert abs(got / sent - 1) <= 0.01


def test_netflow_with_lost_messages(spark):
    rng, sent, secs = Random(21), 0, int(T0.timestamp())
    rows = [(0, encode.message(9, encode.templates(9, rate=100), secs, seq=0))]
    for k in range(1, 6_001):
        records = [FLOW | {"bytes": rng.randint(100, 10_000), "src_port": rng.randint(1024, 65_000), "start_ms": secs * 1000, "end_ms": secs * 1000} for _ in range(20)]
        sent += 100 * sum(r["bytes"] for r in records)
        if rng.random() >= 0.05:
            rows.append((k / 10, encode.message(9, encode.data_sets(9, records, secs), secs, seq=k)))
    got = netflow.records(grams(spark, rows)).agg(F.sum(F.col("bytes") * F.col("mult"))).first()[0]
    assert abs(got / sent - 1) <= 0.015


def test_ipfix_with_a_rate_that_comes_two_minutes_late(spark):
    rng, sent, secs, seq = Random(22), 0, int(T0.timestamp()), 0
    rows = [(0, encode.message(10, encode.templates(10), secs))]
    for k in range(600):
        records = [FLOW | {"bytes": rng.randint(100, 10_000), "start_ms": (secs + k) * 1000, "end_ms": (secs + k) * 1000} for _ in range(10)]
        sent += 10 * sum(r["bytes"] for r in records)
        if k == 120:
            rows.append((k, encode.message(10, encode.templates(10, rate=10), secs + k, seq=seq)))
            seq += 1  # the options record
        rows.append((k, encode.message(10, encode.data_sets(10, records, secs + k), secs + k, seq=seq)))
        seq += 10
    df = grams(spark, rows)
    got = netflow.records(df).agg(F.sum(F.col("bytes") * F.col("mult"))).first()[0]
    assert abs(got / sent - 1) <= 0.001
    session = netflow.Session()
    streamed = [r for s, raw in rows for r in session.take(raw, "e", float(s))]
    assert abs(sum(r["bytes"] * r["mult"] for r in streamed) / sent - 1) <= 0.001


def test_frames_to_the_byte(spark):
    """Unsampled frames, tagged or not, of either family: as many bytes as were sent."""
    rows = []
    for k, more in enumerate(({}, {"vlan": 12}, {"src": "2001:db8::1", "dst": "2001:db8::2"}, {"proto": 17, "vlan": 7})):
        rows.append((k, encode.sflow("10.9.9.9", [encode.flow_sample(FLOW | more, 100 + k, 1, seq=k)], seq=k)))
    got = sflow.records(sflow.samples(grams(spark, rows))).orderBy("bytes").collect()
    assert [(r.bytes, r.mult, r.vlan, r.proto) for r in got] == [(100, 1.0, 0, 6), (101, 1.0, 12, 6), (102, 1.0, 0, 6), (103, 1.0, 7, 17)]
