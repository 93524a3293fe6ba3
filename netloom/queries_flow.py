"""Registered queries over flow rows, summaries and counters, with SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.operators import interfaces, overview, paths, rollups, series, topn, totals
from netloom.plans.query import Filter, Query, step_for
from netloom.plans.tables import Tables

#: The ranges hold their tables whole: all of hot, all of the summaries (r_ts lies in the last of its months), and of ifc
#: what its polls brought (clocks far off put a few rows into other years).
MARCH = Query(datetime(2026, 3, 1), datetime(2026, 4, 1))
QUARTER = Query(datetime(2026, 1, 1), datetime(2026, 4, 1))
POLLED = Query(datetime(2026, 3, 1), datetime(2026, 3, 13))
STEP, QUARTER_STEP, POLLED_STEP = (int(step_for(q.span).total_seconds()) for q in (MARCH, QUARTER, POLLED))
#: A moment after all the data, so that every range is in the past.
NOW = datetime(2026, 7, 1, tzinfo=timezone.utc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_BLANKS = ", ".join([f"coalesce({c}, 0) AS {c}" for c in ("bytes", "wire", "pkts", "flows", "peer_asn")] + [f"coalesce({c}, '') AS {c}" for c in ("peer_cc", "peer_org", "segment", "threat", "app")] + ["coalesce(dup, false) AS dup"])
_FLOWS = f"flows AS (SELECT * REPLACE ({_BLANKS}) FROM (SELECT *, row_number() OVER (PARTITION BY arrival_seq ORDER BY arrived) AS rn FROM hot) WHERE rn = 1 AND ts IS NOT NULL)"
_ADDR = "lower(trim({0}))"
_IP = f"CASE WHEN {_ADDR.format('ip')} LIKE '::ffff:%.%' THEN substr({_ADDR.format('ip')}, 8) ELSE {_ADDR.format('ip')} END"
_EXPORTER = _IP.replace("ip", "exporter").replace("strexporter", "strip")
_PORT = "concat(svc_port, '/', CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE CAST(proto AS VARCHAR) END)"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("bytes", "wire", "pkts", "flows"))


def _rollup_sql(name: str, key: str) -> str:
    shown = f"* REPLACE ({_IP} AS ip)" if key == "ip" else "*"
    return f"{name}_1 AS (SELECT {shown} FROM (SELECT *, row_number() OVER (PARTITION BY arrival_seq ORDER BY arrived) AS rn FROM {name}) WHERE rn = 1 AND ts IS NOT NULL AND {key} IS NOT NULL)"


def _span(q: Query, ts: str = "ts") -> str:
    return f"epoch_us({ts}) >= {int(q.start.timestamp()) * 10**6} AND epoch_us({ts}) < {int(q.end.timestamp()) * 10**6}"


def _detail(q: Query, cond: str = "true", dup: bool = False) -> str:
    return f"WITH {_FLOWS}, d AS (SELECT * FROM flows WHERE {_span(q)} AND {'true' if dup else 'NOT dup'} AND ({cond}))"


def register(name: str, f: Callable[[Tables], DataFrame], sql: str | None = None, summaries: bool = False) -> None:
    """summaries: let them answer where they can. Otherwise the flow rows do, whatever the range."""
    QUERIES[name] = lambda spark, folder: f(Tables.read(spark, folder) if summaries else Tables.read(spark, folder).without_rollups())
    if sql:
        SQL[name] = sql


# -- top-N: every dimension, ranking and source
_KEYS = {
    "client": ("client",), "server": ("server",), "service": ("server", _PORT), "conv": ("client", "server", _PORT), "app": ("app",), "port": (_PORT,),
    "country": ("CASE WHEN dir = 3 THEN '__internal__' ELSE peer_cc END",), "asn": ("CAST(peer_asn AS VARCHAR)",), "proto": ("CAST(proto AS VARCHAR)",), "dir": ("CAST(dir AS VARCHAR)",),
    "exporter": ("exporter",), "segment": ("segment",), "encap": ("CAST(encap AS VARCHAR)",), "threat": ("threat", "client", "server"), "vlan": ("CAST(vlan AS VARCHAR)",),
}
_EXTRA = {"server": "min(peer_cc)", "service": "min(app)", "conv": "min(peer_cc)", "port": "min(app)", "asn": "min(peer_org)", "threat": "concat(min(peer_cc), '|', min(dir))"}
_PEERS = {"client": "server", "server": "client", "service": "client"}
_INTERNAL = {"client": "bool_or(cli_int)", "server": "bool_or(srv_int)", "service": "bool_or(srv_int)"}


def _top_sql(dim: str, by: str = "wire", asc: bool = False, cond: str = "true", dup: bool = False, limit: int = 66) -> str:
    keys = _KEYS[dim]
    cols = ", ".join(f"{k} AS {n}" for n, k in zip(("key", "key2", "key3"), (*keys, "''", "''")))
    peers = f"count(DISTINCT {_PEERS[dim]})" if dim in _PEERS else "0"
    rank = {"avg": "wire / greatest(pkts, 1)"}.get(by, by)
    if dim == "threat":
        cond = f"({cond}) AND threat <> ''"
    return f"""{_detail(MARCH, cond, dup)}, g AS (SELECT {cols}, coalesce({_EXTRA.get(dim, "''")}, '') AS extra, {_SUMS}, CAST({peers} AS BIGINT) AS peers, {_INTERNAL.get(dim, 'false')} AS internal FROM d GROUP BY 1, 2, 3)
        SELECT * FROM g ORDER BY {rank} {'ASC' if asc else 'DESC'}, wire DESC, key, key2, key3 LIMIT {limit}"""


for _d in topn.DIMS:
    register(f"topn_{_d}", lambda t, d=_d: topn.top_n(t, MARCH, d), _top_sql(_d))
for _b in ("bytes", "pkts", "flows", "peers", "avg"):
    register(f"topn_client_by_{_b}", lambda t, b=_b: topn.top_n(t, MARCH, "client", by=b), _top_sql("client", _b))
register("topn_client_avg_asc", lambda t: topn.top_n(t, MARCH, "client", by="avg", asc=True), _top_sql("client", "avg", True))


def _top_rollup_sql(rollup: str) -> str:
    if rollup.startswith("host:"):
        src, key, cond, internal = _rollup_sql("r_host", "ip"), "ip", f"role = {rollup[5:]}", "bool_or(coalesce(internal, false))"
        name, split = "r_host_1", False
    else:
        src, key, cond, internal = _rollup_sql("r_dim", "val"), "val", f"dim = '{rollup}'", "false"
        name, split = "r_dim_1", rollup in ("port", "asn")
    shown = "split_part(key, chr(9), 1) AS key, '' AS key2, '' AS key3, split_part(key, chr(9), 2) AS extra" if split else "key, '' AS key2, '' AS key3, '' AS extra"
    return f"""WITH {src}, g AS (SELECT {key} AS key, {_SUMS}, {internal} AS internal FROM {name} WHERE {cond} AND {_span(QUARTER)} GROUP BY 1 ORDER BY wire DESC, key LIMIT 66)
        SELECT {shown}, bytes, wire, pkts, flows, CAST(0 AS BIGINT) AS peers, internal FROM g"""


for _d, _x in topn.DIMS.items():
    if _x.rollup:
        register(f"topn_rollup_{_d}", lambda t, d=_d: topn.top_n(t, QUARTER, d), _top_rollup_sql(_x.rollup), True)

# -- filters, each on a ranking of conversations
_BYTES_SRC, _BYTES_DST = "(CASE WHEN src = client THEN cli_int ELSE srv_int END)", "(CASE WHEN dst = client THEN cli_int ELSE srv_int END)"
_FILTERS = {
    "ip": ((Filter("ip", "::ffff:10.66.1.10"),), "client = '10.66.1.10' OR server = '10.66.1.10'"),
    "client": ((Filter("client", "10.66.1.10/32"),), "client = '10.66.1.10'"),
    "server": ((Filter("server", "10.66.1.53"),), "server = '10.66.1.53'"),
    "cidr": ((Filter("ip", "10.66.0.0/16"),), "cli4 BETWEEN 172097536 AND 172163071 OR srv4 BETWEEN 172097536 AND 172163071"),
    "src": ((Filter("src", "10.66.1.10"),), "src = '10.66.1.10'"),
    "dst": ((Filter("dst", "10.66.1.10"),), "dst = '10.66.1.10'"),
    "port": ((Filter("port", "443/tcp"),), "svc_port = 443 AND proto = 6"),
    "port_number": ((Filter("port", "53/17"),), "svc_port = 53 AND proto = 17"),
    "app": ((Filter("app", "DNS"),), "app = 'DNS'"),
    "country": ((Filter("country", "de"),), "peer_cc = 'DE'"),
    "country_internal": ((Filter("country", "__internal__"),), "dir = 3"),
    "asn": ((Filter("asn", "AS64977"),), "peer_asn = 64977"),
    "proto": ((Filter("proto", "UDP"),), "proto = 17"),
    "dir": ((Filter("dir", "inbound"),), "dir = 2"),
    "bytes_in": ((Filter("bytes", "in"),), f"NOT {_BYTES_SRC} AND {_BYTES_DST}"),
    "bytes_out": ((Filter("bytes", "out"),), f"{_BYTES_SRC} AND NOT {_BYTES_DST}"),
    "encap": ((Filter("encap", "0"),), "encap = 0"),
    "segment": ((Filter("segment", "seg-15"),), "segment = 'seg-15'"),
    "threat": ((Filter("threat", "", True),), "threat <> ''"),
    "vlan": ((Filter("vlan", "0", True),), "vlan <> 0"),
    "neg": ((Filter("app", "HTTPS", True), Filter("proto", "tcp")), "app <> 'HTTPS' AND proto = 6"),
}
_ONE_DEVICE = {
    "exporter": ((Filter("exporter", "10.66.0.1"),), "exporter = '10.66.0.1'"),
    "iface": ((Filter("iface", "10.66.0.1/4"),), "exporter = '10.66.0.1' AND (in_if = 4 OR out_if = 4)"),
    "iface_in": ((Filter("iface_in", "10.66.0.1/4"),), "exporter = '10.66.0.1' AND in_if = 4"),
    "iface_out": ((Filter("iface_out", "10.66.0.1/4"),), "exporter = '10.66.0.1' AND out_if = 4"),
}
for _n, (_f, _c) in (_FILTERS | _ONE_DEVICE).items():
    register(f"filter_{_n}", lambda t, f=_f: topn.top_n(t, MARCH.also(*f), "conv", 1000), _top_sql("conv", cond=_c, dup=_n in _ONE_DEVICE, limit=1000))
register("filter_include_dup", lambda t: topn.top_n(t, Query(MARCH.start, MARCH.end, include_dup=True), "exporter"), _top_sql("exporter", dup=True))


# -- series
def _series_sql(q: Query, key: str, cond: str, measure: str, k: int, step: int, source: str | None = None, offset: int = 0) -> str:
    start = (int(q.start.timestamp()) + offset) // step * step - offset
    wide = Query(datetime.fromtimestamp(start, timezone.utc), q.end)
    head = source.replace("@span", _span(wide)) if source else f"{_detail(wide, cond)}, b AS (SELECT (epoch_us(ts) // 1000000 + {offset}) // {step} * {step} - {offset} AS bucket, {key} AS name, {measure} AS m FROM d)"
    factor = 8 if measure == "wire" else 1
    end = int(q.end.timestamp())
    return f"""{head}, top AS (SELECT name FROM b GROUP BY 1 ORDER BY sum(m) DESC, name LIMIT {k})
        SELECT bucket, CASE WHEN name IN (SELECT name FROM top) THEN name ELSE '__other__' END AS name,
          round(sum(m)::DOUBLE * {factor} / greatest(1, least(bucket + {step}, {end}) - bucket), 3) AS value, CAST(sum(m) AS BIGINT) AS amount FROM b WHERE bucket < {end} GROUP BY 1, 2"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 3))


_ASN = "concat(peer_asn, chr(9), peer_org)"
_PEER = "CASE WHEN dir = 2 THEN client ELSE server END"
_LINES = {
    "app": ("app", "true"), "client": ("client", "true"), "server": ("server", "true"), "service": (f"concat({_PORT}, chr(9), app)", "svc_port <> 0"),
    "asn_src": (_ASN, f"src = {_PEER}"), "asn_dst": (_ASN, f"dst = {_PEER}"), "if_in": ("concat(exporter, '/', in_if)", "in_if <> 0"), "if_out": ("concat(exporter, '/', out_if)", "out_if <> 0"),
}
for _n, (_k, _c) in _LINES.items():
    register(f"series_{_n}", lambda t, n=_n: _rounded(series.series_by(t, MARCH, n, now=NOW)), _series_sql(MARCH, _k, _c, "wire", 8, STEP))
register("series_pkts", lambda t: _rounded(series.series_by(t, MARCH, "app", "pkts", 5, now=NOW)), _series_sql(MARCH, "app", "true", "pkts", 5, STEP))
_TOKYO = Query(MARCH.start, MARCH.end, (Filter("vlan", "4095", True),), offset=timedelta(hours=9))
register("series_tz", lambda t: _rounded(series.series_by(t, _TOKYO, "app", now=NOW)), _series_sql(_TOKYO, "app", "vlan <> 4095", "wire", 8, STEP, offset=32400))
_TS_SOURCE = f"WITH {_rollup_sql('r_ts', 'app')}, b AS (SELECT epoch_us(ts) // 1000000 // {STEP} * {STEP} AS bucket, app AS name, wire AS m FROM r_ts_1 WHERE @span)"
register("series_rollup_app", lambda t: _rounded(series.series_by(t, MARCH, "app", now=NOW)), _series_sql(MARCH, "app", "true", "wire", 8, STEP, _TS_SOURCE), True)
_HOST_SOURCE = f"WITH {_rollup_sql('r_host', 'ip')}, b AS (SELECT epoch_us(ts) // 1000000 // {QUARTER_STEP} * {QUARTER_STEP} AS bucket, ip AS name, wire AS m FROM r_host_1 WHERE role = 1 AND @span)"
register("series_rollup_client", lambda t: _rounded(series.series_by(t, QUARTER, "client", now=NOW)), _series_sql(QUARTER, "ip", "true", "wire", 8, QUARTER_STEP, _HOST_SOURCE), True)
register(
    "series_total", lambda t: _rounded(series.total_series(t, MARCH, NOW)),
    f"""{_detail(MARCH)}, n AS (SELECT unnest(range({int(MARCH.start.timestamp())}, {int(MARCH.end.timestamp())}, {STEP})) AS bucket)
        SELECT n.bucket, round(coalesce(sum(wire), 0)::DOUBLE * 8 / {STEP}, 3) AS value FROM n LEFT JOIN d ON epoch_us(ts) // 1000000 // {STEP} * {STEP} = n.bucket GROUP BY 1""",
)

# -- totals, records
_TOTALS = """SELECT {sums}, CAST((SELECT count(*) FROM (SELECT client FROM d WHERE cli_int UNION SELECT server FROM d WHERE srv_int)) AS BIGINT) AS hosts,
    CAST((SELECT count(*) FROM (SELECT DISTINCT CASE WHEN NOT srv_int THEN server ELSE client END FROM d WHERE NOT srv_int OR NOT cli_int)) AS BIGINT) AS peers,
    CAST(count(DISTINCT nullif(peer_cc, '')) AS BIGINT) AS countries FROM d""".format(sums=_SUMS)
register("totals", lambda t: totals.totals(t, MARCH), f"{_detail(MARCH)} {_TOTALS}")
_DEVICE = MARCH.also(Filter("exporter", "10.66.0.1"))
register("totals_device", lambda t: totals.totals(t, _DEVICE), f"{_detail(MARCH, _ONE_DEVICE['exporter'][1], True)} {_TOTALS}")
register(
    "totals_rollup", lambda t: totals.totals(t, QUARTER),
    f"""WITH {_rollup_sql('r_ts', 'app')}, {_rollup_sql('r_host', 'ip')}, {_rollup_sql('r_dim', 'val')}
        SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(wire), 0) AS BIGINT) AS wire, CAST(coalesce(sum(pkts), 0) AS BIGINT) AS pkts, CAST(coalesce(sum(flows), 0) AS BIGINT) AS flows,
          (SELECT count(DISTINCT ip) FROM r_host_1 WHERE internal AND {_span(QUARTER)}) AS hosts, (SELECT count(DISTINCT ip) FROM r_host_1 WHERE NOT internal AND {_span(QUARTER)}) AS peers,
          (SELECT count(DISTINCT val) FROM r_dim_1 WHERE dim = 'country' AND val NOT IN ('', '__internal__') AND {_span(QUARTER)}) AS countries FROM r_ts_1 WHERE {_span(QUARTER)}""", True,
)
register("host_counts", lambda t: totals.host_counts(t, MARCH.also(Filter("dir", "internal", True))), f"""{_detail(MARCH, "dir <> 3")}
        SELECT (SELECT count(*) FROM (SELECT client FROM d WHERE cli_int UNION SELECT server FROM d WHERE srv_int)) AS hosts,
          (SELECT count(*) FROM (SELECT DISTINCT CASE WHEN NOT srv_int THEN server ELSE client END FROM d WHERE NOT srv_int OR NOT cli_int)) AS peers""")  # fmt: skip
register("records_page", lambda t: totals.records(t, MARCH, 200, 100), f"""{_detail(MARCH)} SELECT epoch_us(ts) // 1000 AS ts_ms, client, server, CASE WHEN client = src THEN sport ELSE dport END AS cport, svc_port, proto, app, peer_cc, peer_asn, encap, wire, pkts, exporter, in_if, out_if, vlan, tcp_flags, mult, dir, threat
        FROM d ORDER BY ts DESC, wire DESC, client, server, cport, svc_port, proto, exporter, in_if, out_if, dir, vlan, pkts, src LIMIT 200 OFFSET 100""")  # fmt: skip
register("record_counts", lambda t: totals.record_counts(t, MARCH), f"{_detail(MARCH)} SELECT epoch_us(ts) // 1000000 // {STEP} * {STEP} AS bucket, count(*) AS rows, CAST(sum(flows) AS BIGINT) AS flows FROM d GROUP BY 1")

# -- paths and rings
_PATHS = {"host": ("CASE WHEN dir = 2 THEN server ELSE client END", "app"), "segment": ("segment", "app"), "conv": ("client", _PORT)}
_CC = "CASE WHEN dir = 3 THEN '__internal__' WHEN peer_cc = '' THEN '__unknown__' ELSE peer_cc END"
for _n, (_a, _b) in _PATHS.items():
    _m = 8 if _n == "conv" else 6
    register(f"sankey_{_n}", lambda t, n=_n, m=_m: paths.sankey(t, MARCH, n, 8, m), f"""{_detail(MARCH)}, b AS (SELECT {_a} AS c0, {_b} AS c1, {'server' if _n == 'conv' else _CC} AS c2, wire AS w FROM d),
        t0 AS (SELECT c0 FROM b GROUP BY 1 ORDER BY sum(w) DESC, c0 LIMIT 8), t2 AS (SELECT c2 FROM b GROUP BY 1 ORDER BY sum(w) DESC, c2 LIMIT {_m})
        SELECT CASE WHEN c0 IN (SELECT c0 FROM t0) THEN c0 ELSE '__other__' END AS c0, c1, CASE WHEN c2 IN (SELECT c2 FROM t2) THEN c2 ELSE '__other__' END AS c2, CAST(sum(w) AS BIGINT) AS wire FROM b GROUP BY 1, 2, 3""")  # fmt: skip
_LINKS = f"""{_detail(MARCH)}, b AS (SELECT {_PATHS['host'][0]} AS c0, app AS c1, {_CC} AS c2, wire AS w FROM d),
        t0 AS (SELECT c0 FROM b GROUP BY 1 ORDER BY sum(w) DESC, c0 LIMIT 8), t2 AS (SELECT c2 FROM b GROUP BY 1 ORDER BY sum(w) DESC, c2 LIMIT 6),
        l AS (SELECT CASE WHEN c0 IN (SELECT c0 FROM t0) THEN c0 ELSE '__other__' END AS c0, c1, CASE WHEN c2 IN (SELECT c2 FROM t2) THEN c2 ELSE '__other__' END AS c2, sum(w) AS w FROM b GROUP BY 1, 2, 3),
        k0 AS (SELECT c0 FROM l GROUP BY 1 ORDER BY sum(w) DESC, c0 LIMIT 8), k1 AS (SELECT c1 FROM l GROUP BY 1 ORDER BY sum(w) DESC, c1 LIMIT 6), k2 AS (SELECT c2 FROM l GROUP BY 1 ORDER BY sum(w) DESC, c2 LIMIT 6),
        f AS (SELECT CASE WHEN c0 IN (SELECT c0 FROM k0) THEN c0 ELSE '__other__' END AS c0, CASE WHEN c1 IN (SELECT c1 FROM k1) THEN c1 ELSE '__other__' END AS c1, CASE WHEN c2 IN (SELECT c2 FROM k2) THEN c2 ELSE '__other__' END AS c2, w FROM l)
        SELECT 1 AS side, c0 AS source, c1 AS target, CAST(sum(w) AS BIGINT) AS wire FROM f GROUP BY 2, 3 UNION ALL SELECT 2, c1, c2, CAST(sum(w) AS BIGINT) FROM f GROUP BY 2, 3"""
register("sankey_links", lambda t: paths.sankey_links(t, MARCH), _LINKS)
_RINGS = {"server": "server", "client": "client", "service": f"concat({_PORT}, chr(9), app)"}
for _i, _o in (("server", "client"), ("client", "server"), ("service", "server")):
    _c = "svc_port <> 0" if "service" in (_i, _o) else "true"
    register(f"rings_{_i}_{_o}", lambda t, i=_i, o=_o: paths.rings(t, MARCH, i, o), f"""{_detail(MARCH, _c)}, x AS (SELECT {_RINGS[_i]} AS i, {_RINGS[_o]} AS o, wire AS w FROM d),
        ti AS (SELECT i FROM x GROUP BY 1 ORDER BY sum(w) DESC, i LIMIT 8),
        p AS (SELECT CASE WHEN i IN (SELECT i FROM ti) THEN i ELSE '__other__' END AS i, CASE WHEN i IN (SELECT i FROM ti) THEN o ELSE '__other__' END AS o, CAST(sum(w) AS BIGINT) AS w FROM x GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, o) AS rn FROM p)
        SELECT 1 AS level, '' AS parent, i AS key, CAST(sum(w) AS BIGINT) AS wire FROM p GROUP BY i
        UNION ALL SELECT 2, i, CASE WHEN rn <= 8 AND i <> '__other__' THEN o ELSE '__other__' END, CAST(sum(w) AS BIGINT) FROM r GROUP BY 2, 3 HAVING sum(w) > 0""")  # fmt: skip
_SEG = f"""{_detail(MARCH, "dir IN (1, 2) AND peer_cc <> ''")}, s AS (SELECT segment, peer_cc AS country, CAST(sum(wire) AS BIGINT) AS wire FROM d GROUP BY 1, 2 ORDER BY wire DESC, segment, country LIMIT 2000)"""
register("segment_countries", lambda t: paths.segment_countries(t, MARCH), f"{_SEG} SELECT * FROM s")


def _origins(t: Tables) -> DataFrame:
    """Where each segment is, for the map: a fixed rule over the segments' numbers."""
    number = F.expr("CASE WHEN segment LIKE 'seg-%' THEN try_cast(substr(segment, 5) AS INT) END")
    return t.rows().select("segment").distinct().select("segment", F.when(number % 3 == 0, "DE").when(number % 3 == 1, "JP").otherwise("").alias("cc"))


register("geo_lines", lambda t: paths.geo_lines(t, MARCH, _origins(t)), f"""{_SEG}, o AS (SELECT *, CASE try_cast(substr(segment, 5) AS INT) % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'JP' ELSE '' END AS source FROM s WHERE segment LIKE 'seg-%')
        SELECT source, country AS target, CAST(sum(wire) AS BIGINT) AS wire FROM o WHERE source <> '' AND source <> country GROUP BY 1, 2""")  # fmt: skip

# -- interfaces. The counters of the test tables end the day before the flows begin; the flows are read a week earlier.


def _shifted(t: Tables) -> Tables:
    return replace(t, flows=t.flows.withColumn("ts", F.col("ts") - F.expr("interval 7 days")))


_BACK = _FLOWS.replace("SELECT * REPLACE (", "SELECT * REPLACE (ts - INTERVAL 7 DAY AS ts, ")
_SNAP = f"snap AS (SELECT exporter, ifindex, us, arg_min(in_oct, arrived) AS in_oct, arg_min(out_oct, arrived) AS out_oct, arg_min(in_pkts, arrived) AS in_pkts, arg_min(out_pkts, arrived) AS out_pkts FROM (SELECT {_EXPORTER} AS exporter, ifindex, epoch_us(ts) AS us, in_oct, out_oct, in_pkts, out_pkts, arrived FROM ifc WHERE ts IS NOT NULL AND in_oct IS NOT NULL AND out_oct IS NOT NULL @more) WHERE us >= @lo AND us < @hi GROUP BY 1, 2, 3)"


def _pairs_sql(q: Query, before: int, after: int, pkts: bool) -> str:
    lo, hi = int(q.start.timestamp()) * 10**6, int(q.end.timestamp()) * 10**6
    snap = _SNAP.replace("@more", "AND in_pkts IS NOT NULL AND out_pkts IS NOT NULL" if pkts else "").replace("@lo", str(lo - before)).replace("@hi", str(hi + after))
    cols = ("in_oct", "out_oct", "in_pkts", "out_pkts") if pkts else ("in_oct", "out_oct")
    lags = ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ("us", *cols))
    rose = " AND ".join(f"{c} >= p_{c}" for c in cols)
    return f"{snap}, pairs AS (SELECT * FROM (SELECT *, {lags} FROM snap WINDOW w AS (PARTITION BY exporter, ifindex ORDER BY us)) WHERE us - p_us < 3600000000 AND {rose})"


def _cells_sql(lo: int, hi: int, step: int, cols: tuple[str, ...]) -> str:
    part = ", ".join(f"({c} - p_{c}) * ov / (us - p_us) AS {c}" for c in cols)
    return f"""cut AS (SELECT *, greatest(p_us, {lo}) AS a, least(us, {hi}) AS z FROM pairs), grid AS (SELECT *, unnest(range(a // {step}, (z - 1) // {step} + 1)) * {step} AS b0 FROM cut WHERE z > a),
        cells AS (SELECT exporter, ifindex, b0 // 1000000 AS bucket, ov / 1e6 AS secs, {part} FROM (SELECT *, (least(b0 + {step}, z) - greatest(b0, a))::DOUBLE AS ov FROM grid))"""


_W0, _W1 = int(POLLED.start.timestamp()) * 10**6, int(POLLED.end.timestamp()) * 10**6
register("iface_hours", lambda t: interfaces.interface_hours(t, POLLED), f"""WITH {_pairs_sql(POLLED, 3600 * 10**6, 3600 * 10**6, True)}, {_cells_sql(_W0, _W1, 3600 * 10**6, ('in_oct', 'out_oct', 'in_pkts', 'out_pkts'))}
        SELECT bucket AS start, exporter, ifindex, CAST(round(sum(in_oct)) AS BIGINT) AS in_oct, CAST(round(sum(out_oct)) AS BIGINT) AS out_oct, CAST(round(sum(in_pkts)) AS BIGINT) AS in_pkts, CAST(round(sum(out_pkts)) AS BIGINT) AS out_pkts FROM cells GROUP BY 1, 2, 3""")  # fmt: skip
_RECON_STEP = POLLED_STEP
_N = (_W1 - _W0) // 10**6 // _RECON_STEP + 1
_RECON = f"""WITH {_BACK}, {_pairs_sql(POLLED, 600 * 10**6, 0, False)}, {_cells_sql(_W0, _W0 + _N * _RECON_STEP * 10**6, _RECON_STEP * 10**6, ('in_oct', 'out_oct'))},
        c AS (SELECT exporter, ifindex, bucket, sum(in_oct) AS in_ctr, sum(out_oct) AS out_ctr, sum(secs) AS secs FROM cells GROUP BY 1, 2, 3),
        fi AS (SELECT exporter, in_if AS ifindex, epoch_us(ts) // 1000000 // {_RECON_STEP} * {_RECON_STEP} AS bucket, sum(wire) AS w FROM flows WHERE in_if <> 0 AND {_span(POLLED)} GROUP BY 1, 2, 3),
        fo AS (SELECT exporter, out_if AS ifindex, epoch_us(ts) // 1000000 // {_RECON_STEP} * {_RECON_STEP} AS bucket, sum(wire) AS w FROM flows WHERE out_if <> 0 AND {_span(POLLED)} GROUP BY 1, 2, 3),
        r AS (SELECT coalesce(c.exporter, fi.exporter, fo.exporter) AS exporter, coalesce(c.ifindex, fi.ifindex, fo.ifindex) AS ifindex, coalesce(c.bucket, fi.bucket, fo.bucket) AS bucket,
          coalesce(secs, 0) >= {0.9 * _RECON_STEP} AS covered, coalesce(in_ctr, 0) AS in_ctr, coalesce(out_ctr, 0) AS out_ctr, coalesce(fi.w, 0) AS in_flow, coalesce(fo.w, 0) AS out_flow
          FROM c FULL JOIN fi ON c.exporter = fi.exporter AND c.ifindex = fi.ifindex AND c.bucket = fi.bucket
          FULL JOIN fo ON coalesce(c.exporter, fi.exporter) = fo.exporter AND coalesce(c.ifindex, fi.ifindex) = fo.ifindex AND coalesce(c.bucket, fi.bucket) = fo.bucket)"""
register(
    "recon", lambda t: interfaces.recon_buckets(_shifted(t), POLLED).select("exporter", "ifindex", "bucket", "covered", F.round("in_ctr", 0).alias("in_ctr"), F.round("out_ctr", 0).alias("out_ctr"), F.col("in_flow").cast("long").alias("in_flow"), F.col("out_flow").cast("long").alias("out_flow")),
    f"{_RECON} SELECT exporter, ifindex, bucket, covered, round(in_ctr) AS in_ctr, round(out_ctr) AS out_ctr, CAST(in_flow AS BIGINT) AS in_flow, CAST(out_flow AS BIGINT) AS out_flow FROM r",
)
register(
    "recon_summary", lambda t: interfaces.recon(_shifted(t), POLLED).select("exporter", "ifindex", "buckets", F.round("in_dev", 6).alias("in_dev"), F.round("out_dev", 6).alias("out_dev"), "in_flow_bytes", "in_no_flow", "out_no_flow"),
    f"""{_RECON}, s AS (SELECT exporter, ifindex, count(*) AS buckets, sum(in_ctr) AS ic, sum(out_ctr) AS oc, sum(in_flow) AS i, sum(out_flow) AS o FROM r WHERE covered AND bucket + {_RECON_STEP} <= {_W1 // 10**6} GROUP BY 1, 2)
        SELECT exporter, ifindex, buckets, round(CASE WHEN ic > 0 THEN (i - ic) / ic ELSE 0 END, 6) AS in_dev, round(CASE WHEN oc > 0 THEN (o - oc) / oc ELSE 0 END, 6) AS out_dev, CAST(i AS BIGINT) AS in_flow_bytes, ic > 0 AND i = 0 AS in_no_flow, oc > 0 AND o = 0 AS out_no_flow FROM s""",
)
register(
    "percentile_p95", lambda t: interfaces.counter_figures(_shifted(t), POLLED).select("exporter", "ifindex", *[F.round(c, 1).alias(c) for c in ("in_avg", "in_peak", "in95", "out_avg", "out_peak", "out95")], F.round("coverage", 6).alias("coverage")),
    f"""{_RECON}, v AS (SELECT *, in_ctr * 8 / {_RECON_STEP} AS i, out_ctr * 8 / {_RECON_STEP} AS o FROM r WHERE covered AND bucket + {_RECON_STEP} <= {_W1 // 10**6})
        SELECT exporter, ifindex, round(avg(i), 1) AS in_avg, round(max(i), 1) AS in_peak, round(percentile_disc(0.95) WITHIN GROUP (ORDER BY i), 1) AS in95, round(avg(o), 1) AS out_avg, round(max(o), 1) AS out_peak, round(percentile_disc(0.95) WITHIN GROUP (ORDER BY o), 1) AS out95, round(count(*)::DOUBLE / {_N}, 6) AS coverage FROM v GROUP BY 1, 2""",
)
register(
    "interfaces", lambda t: interfaces.interfaces(_shifted(t), POLLED).drop("peer"),
    f"""WITH {_BACK}, k AS (SELECT {_EXPORTER} AS exporter, ifindex, coalesce(max(speed), 0) AS speed, true AS counters FROM ifc WHERE {_span(POLLED)} GROUP BY 1, 2),
        i AS (SELECT exporter, in_if AS ifindex, CAST(sum(wire) AS BIGINT) AS in_wire FROM flows WHERE in_if <> 0 AND {_span(POLLED)} GROUP BY 1, 2),
        o AS (SELECT exporter, out_if AS ifindex, CAST(sum(wire) AS BIGINT) AS out_wire FROM flows WHERE out_if <> 0 AND {_span(POLLED)} GROUP BY 1, 2)
        SELECT exporter, ifindex, coalesce(speed, 0) AS speed, coalesce(counters, false) AS counters, coalesce(in_wire, 0) AS in_wire, coalesce(out_wire, 0) AS out_wire
        FROM k FULL JOIN i USING (exporter, ifindex) FULL JOIN o USING (exporter, ifindex)""",
)
_PEERED = f"""{SQL['interfaces'].replace('SELECT exporter, ifindex, coalesce(speed, 0)', ', listed AS (SELECT exporter, ifindex, coalesce(speed, 0)')}), whole AS (SELECT exporter, sum(wire) AS w FROM flows WHERE {_span(POLLED)} GROUP BY 1),
    near AS (SELECT l.*, coalesce(w, 0) > 0 AND in_wire + out_wire >= 0.9 * w AND in_wire + out_wire > 0 AS nearly FROM listed l LEFT JOIN whole USING (exporter)),
    peered AS (SELECT exporter, ifindex, speed, counters, in_wire, out_wire, in_wire + out_wire > 0 AND bool_or(nearly) OVER (PARTITION BY exporter) AND NOT nearly AS peer FROM near)"""
register("interface_peers", lambda t: interfaces.interfaces(_shifted(t), POLLED), f"{_PEERED} SELECT * FROM peered")
_BUCKETS = _N - 1  # the range ends with a bucket
_RANK = -(-95 * _BUCKETS // 100)
_FIGURES = ("in_avg", "in_peak", "in95", "out_avg", "out_peak", "out95")
_SIDE = f"""SELECT exporter, {{0}}_if AS ifindex, epoch_us(ts) // 1000000 // {POLLED_STEP} AS b, sum(wire) AS w FROM flows WHERE {{0}}_if <> 0 AND {_span(POLLED)} GROUP BY 1, 2, 3"""
_FLOW_SIDE = f"""{{0}}f AS (SELECT exporter, ifindex, sum(w) * 8.0::DOUBLE / {int(POLLED.span.total_seconds())} AS {{0}}_avg, max(v) AS {{0}}_peak, coalesce(max(v) FILTER (rn + {_BUCKETS} - n = {_RANK}), 0) AS {{0}}95 FROM (
    SELECT *, w * 8.0::DOUBLE / {POLLED_STEP} AS v, row_number() OVER (PARTITION BY exporter, ifindex ORDER BY w) AS rn, count(*) OVER (PARTITION BY exporter, ifindex) AS n FROM ({_SIDE})) GROUP BY 1, 2)"""
register(
    "report_interfaces", lambda t: interfaces.report_interfaces(_shifted(t), POLLED).select("exporter", "ifindex", "speed", "in_wire", "out_wire", "peer", "source", *[F.round(c, 2).alias(c) for c in _FIGURES], F.round("coverage", 6).alias("coverage"), F.round("util95", 4).alias("util95")),
    f"""{_PEERED}, {_RECON.removeprefix(f'WITH {_BACK}, ').replace('fi AS', 'fi2 AS').replace('fo AS', 'fo2 AS').replace('fi.', 'fi2.').replace('fo.', 'fo2.').replace('JOIN fi ', 'JOIN fi2 ').replace('JOIN fo ', 'JOIN fo2 ')}, {_FLOW_SIDE.format('in')}, {_FLOW_SIDE.format('out')},
        v AS (SELECT *, in_ctr * 8 / {_RECON_STEP} AS i, out_ctr * 8 / {_RECON_STEP} AS o FROM r WHERE covered AND bucket + {_RECON_STEP} <= {_W1 // 10**6}),
        cf AS (SELECT exporter, ifindex, avg(i) AS in_avg, max(i) AS in_peak, percentile_disc(0.95) WITHIN GROUP (ORDER BY i) AS in95, avg(o) AS out_avg, max(o) AS out_peak, percentile_disc(0.95) WITHIN GROUP (ORDER BY o) AS out95, count(*)::DOUBLE / {_N} AS coverage FROM v GROUP BY 1, 2),
        a AS (SELECT p.exporter, p.ifindex, speed, in_wire, out_wire, peer, CASE WHEN coverage IS NULL THEN 'flows' ELSE 'counters' END AS source, coalesce(coverage, 0) AS coverage,
          {', '.join(f"CASE WHEN coverage IS NULL THEN coalesce({'inf' if c.startswith('in') else 'outf'}.{c}, 0) ELSE cf.{c} END AS {c}" for c in _FIGURES)}
          FROM peered p LEFT JOIN cf USING (exporter, ifindex) LEFT JOIN inf USING (exporter, ifindex) LEFT JOIN outf USING (exporter, ifindex))
        SELECT exporter, ifindex, speed, in_wire, out_wire, peer, source, {', '.join(f'round({c}, 2) AS {c}' for c in _FIGURES)}, round(coverage, 6) AS coverage, round(CASE WHEN speed > 0 THEN greatest(in95, out95) / speed * 100 ELSE 0 END, 4) AS util95 FROM a""",
)

# -- overview and report


_APRIL = MARCH.shifted(MARCH.span)


def _ahead(t: Tables) -> Tables:
    """The flows and the same flows a range later, so that a range has one to be compared with."""
    later = t.flows.withColumn("ts", F.col("ts") + F.expr(f"interval {MARCH.span.days} days"))
    return replace(t, flows=t.flows.unionByName(later))


register("overview_totals", lambda t: overview.totals_with_base(_ahead(t), _APRIL), f"""WITH {_FLOWS}, d AS (SELECT * FROM flows WHERE NOT dup AND {_span(MARCH)}), t AS ({_TOTALS}) SELECT 'now' AS which, * FROM t UNION ALL SELECT 'prev', * FROM t""")
for _d, _k in (("dir", 4), ("proto", 2), ("country", 3)):
    register(f"overview_share_{_d}", lambda t, d=_d, k=_k: overview.shares(t, MARCH, d, k), f"""{_detail(MARCH)}, g AS (SELECT {_KEYS[_d][0]} AS key, CAST(sum(wire) AS BIGINT) AS wire FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
        r AS (SELECT *, row_number() OVER (ORDER BY wire DESC, key) AS rn FROM g) SELECT CASE WHEN rn <= {_k} AND key <> '' THEN key ELSE '__other__' END AS key, CAST(sum(wire) AS BIGINT) AS wire FROM r GROUP BY 1 HAVING sum(wire) > 0""")  # fmt: skip
register("overview_top_clients", lambda t: overview.top_with_base(_ahead(t), _APRIL), f"""{_detail(MARCH)}, k AS (SELECT client AS key, CAST(sum(wire) AS BIGINT) AS wire FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
        e AS (SELECT client AS key, wire FROM d UNION ALL SELECT server, wire FROM d WHERE server <> client)
        SELECT key, k.wire, CAST(coalesce(sum(e.wire), 0) AS BIGINT) AS base FROM k LEFT JOIN e USING (key) GROUP BY 1, 2""")  # fmt: skip
register("report_head", lambda t: overview.report_head(t, MARCH, NOW).select("wire", F.round("avg_bps", 3).alias("avg_bps"), F.round("peak_bps", 3).alias("peak_bps"), F.round("p95_bps", 3).alias("p95_bps")), f"""{_detail(MARCH)}, n AS (SELECT unnest(range({int(MARCH.start.timestamp())}, {int(MARCH.end.timestamp())}, {STEP})) AS bucket),
        v AS (SELECT n.bucket, coalesce(sum(wire), 0)::DOUBLE * 8 / {STEP} AS value FROM n LEFT JOIN d ON epoch_us(ts) // 1000000 // {STEP} * {STEP} = n.bucket GROUP BY 1)
        SELECT (SELECT CAST(sum(wire) AS BIGINT) FROM d) AS wire, round((SELECT sum(wire)::DOUBLE * 8 / {int(MARCH.span.total_seconds())} FROM d), 3) AS avg_bps, round(max(value), 3) AS peak_bps, round(percentile_disc(0.95) WITHIN GROUP (ORDER BY value), 3) AS p95_bps FROM v""")  # fmt: skip

_AT = datetime(2026, 3, 10, 1, 0, 30, tzinfo=timezone.utc)
register("overview_rate", lambda t: overview.current_rate(t, MARCH, _AT), f"""{_detail(Query(datetime(2026, 3, 10, 0, 55), datetime(2026, 3, 10, 1)))} SELECT CAST(coalesce(sum(wire), 0) AS BIGINT) * 8 / 300.0::DOUBLE AS now_bps FROM d""")
register("series_totals_app", lambda t: series.series_totals(t, MARCH, "app"), f"""{_detail(MARCH)}, g AS (SELECT app, CAST(sum(wire) AS BIGINT) AS w FROM d GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY w DESC, app) AS rn FROM g)
        SELECT CASE WHEN rn <= 8 THEN app ELSE '__other__' END AS name, CAST(sum(w) AS BIGINT) AS amount FROM n GROUP BY 1""")  # fmt: skip

register("series_distinct_apps", lambda t: series.distinct_values(t, MARCH, "app"), f"{_detail(MARCH)} SELECT count(DISTINCT app) AS n FROM d")

# -- summaries from flow rows
_DIM_SQL = [("app", "app", "true"), ("port", f"concat({_PORT}, chr(9), app)", "true"), ("country", "CASE WHEN dir = 3 THEN '__internal__' ELSE peer_cc END", "true"), ("proto", "CAST(proto AS VARCHAR)", "true"), ("dir", "CAST(dir AS VARCHAR)", "true"), ("exporter", "exporter", "true"), ("segment", "segment", "true"), ("encap", "CAST(encap AS VARCHAR)", "true"), ("asn", _ASN, "peer_asn <> 0")]
_HOUR = "epoch_us(ts) // 3600000000 * 3600 AS ts_s"
_epoch = lambda df: df.withColumn("ts_s", F.unix_seconds("ts")).drop("ts")
register("rollup_ts", lambda t: _epoch(rollups.r_ts(t.rows())), f"WITH {_FLOWS} SELECT epoch_us(ts) // 1000000 AS ts_s, app, {_SUMS} FROM flows WHERE NOT dup GROUP BY 1, 2")
register("rollup_host", lambda t: _epoch(rollups.r_host(t.rows())), f"WITH {_FLOWS} SELECT {_HOUR}, client AS ip, 1 AS role, cli_int AS internal, {_SUMS} FROM flows WHERE NOT dup GROUP BY 1, 2, 4 UNION ALL SELECT {_HOUR}, server, 2, srv_int, {_SUMS} FROM flows WHERE NOT dup GROUP BY 1, 2, 4")
register("rollup_dim", lambda t: _epoch(rollups.r_dim(t.rows())), f"WITH {_FLOWS} " + " UNION ALL ".join(f"SELECT {_HOUR}, '{d}' AS dim, {v} AS val, {_SUMS} FROM flows WHERE NOT dup AND {ok} GROUP BY 1, 3" for d, v, ok in _DIM_SQL))
_VIEWS = f"v AS (SELECT *, exporter AS iface, 0 AS side FROM flows UNION ALL SELECT *, concat(exporter, '/', in_if), CASE WHEN in_if = out_if THEN 3 ELSE 1 END FROM flows WHERE in_if <> 0 UNION ALL SELECT *, concat(exporter, '/', out_if), 2 FROM flows WHERE out_if <> 0 AND out_if <> in_if)"
register("view_ts_if", lambda t: _epoch(rollups.r_ts_if(t.rows())), f"WITH {_FLOWS}, {_VIEWS} SELECT epoch_us(ts) // 300000000 * 300 AS ts_s, iface, side, app, {_SUMS} FROM v GROUP BY 1, 2, 3, 4")
register("view_dim_if", lambda t: _epoch(rollups.r_dim_if(t.rows())), f"WITH {_FLOWS}, {_VIEWS} " + " UNION ALL ".join(f"SELECT {_HOUR}, iface, side, '{d}' AS dim, {v} AS val, {_SUMS} FROM v WHERE {ok} GROUP BY 1, 2, 3, 5" for d, v, ok in _DIM_SQL))
