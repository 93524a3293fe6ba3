"""Records and flow rows for tests."""

from datetime import datetime, timedelta, timezone

from netloom.operators import ingest

T0 = datetime(2026, 3, 10, 10, 0, tzinfo=timezone.utc)
BASE = dict(
    start=T0, end=T0, src="10.0.0.1", dst="192.0.2.7", src_port=50000, dst_port=443, proto=6, tcp_flags=0, tos=0, bytes=1000, packets=10, l2=False, l2_hdr=0, sampling=1, mult=1.0, sampling_known=True,
    in_if=1, out_if=2, vlan=0, encap=0, direction=0, opener=0, src_as=0, dst_as=0, exporter="10.9.9.9", domain=0, observation=0, source=4, arrival_seq=0,
)
NAMES = [c.split()[0] for c in ingest.RECORD.split(", ")]


def records(spark, rows):
    """Rows as changes to BASE; times in seconds after T0 may be given as numbers."""
    out = []
    for i, r in enumerate(rows):
        full = BASE | {"arrival_seq": i} | r
        for k in ("start", "end"):
            if isinstance(full[k], (int, float)):
                full[k] = T0 + timedelta(seconds=full[k])
        out.append(tuple(full[n] for n in NAMES))
    return spark.createDataFrame(out, ingest.RECORD)


def flow_rows(spark, rows, now=T0 + timedelta(days=1), **more):
    """Rows made once and held as literal rows, so that what is tested doesn't make them again."""
    df = ingest.flow_rows(records(spark, rows), now, **more)
    return spark.createDataFrame(df.collect(), df.schema)
