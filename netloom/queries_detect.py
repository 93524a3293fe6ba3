"""Registered detection queries. The test tables are sparse, so thresholds are lowered here, in both engines alike."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from netloom.detect import findings, rules
from netloom.operators import overview
from netloom.plans.query import Query
from netloom.plans.tables import Tables
from netloom.queries_flow import _FLOWS, _rollup_sql, SQL as _SQLS, register

LOW = rules.Limits(
    scan_targets=4, scan_targets_sampled=2, scan_ports=3, scan_ports_sampled=2, brute=2, brute_sampled=1, fast_targets=2, fast_ports=2, beacon_minutes=3, beacon_bytes=500_000, beacon_jitter=0.6,
    probe_avg=900, icmp_avg=900, brute_avg=2000, exfil_bytes=200_000, exfil_ratio=1.5, flood_pps=1.0, flood_avg=900, flood_ratio=0.02, model_orgs=("net 1", "net 2", "transit"), model_bytes=50_000, new_service_clients=50, chain_within=3600,
)
#: A run of thirty days, which holds all of hot.
RUN = Query(datetime(2026, 3, 1), datetime(2026, 3, 31))
_S, _E = int(RUN.start.timestamp()), int(RUN.end.timestamp())
_W = f"""WITH {_FLOWS}, w AS (SELECT *, epoch_us(ts) // 1000000 AS t, unnest(range(epoch_us(ts) // 300000000 * 300 + 300, epoch_us(ts) // 1000000 + 601, 300)) AS win FROM flows WHERE NOT dup),
    r AS (SELECT *, CASE WHEN src = client THEN cli_int ELSE srv_int END AS own FROM w WHERE win > {_S} AND win <= {_E} AND win - 600 <= t AND t < {_E})"""
_COMMON = "CAST(sum(pkts) AS BIGINT) AS pkts, sum(wire) AS wire, max(mult)::DOUBLE AS sampling, min(t) AS first_s, max(t) + 60 AS last_s, bool_or(own) AS own, sum(pkts / greatest(mult, 1)) AS seen"


def _rows(t: Tables) -> DataFrame:
    return rules.windowed(t.rows(), LOW, RUN.start, RUN.end)


def _plain(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("win", "kind", "sev", "src", "dst", "port", F.unix_seconds("first").alias("first_s"), F.unix_seconds("last").alias("last_s"), *[F.expr(_SHOWN.get(k, k)).alias(k) for k in keep])


def _add(name: str, rule, sql: str, *keep: str, summaries: bool = False) -> None:
    register(f"detect_{name}", lambda t: _plain(rule(t), *keep), f"{_W}, {sql}", summaries)


_MORE = "sampling, round(wire::DOUBLE / greatest(pkts, 1), 6) AS avg"
_FEW = "array_to_string(list_sort(list(DISTINCT {0}))[1:{1}], ',') AS examples"
_SHOWN = {c: f"round({c}, 6)" for c in ("avg", "jitter", "pps", "usual")} | {"examples": "array_join(examples, ',')"}
_SEV = "CASE WHEN own THEN 3 ELSE 1 END"
_LABEL = "CASE WHEN proto IN (1, 58) THEN 'icmp' WHEN proto = 17 THEN concat({0}, '/udp') ELSE concat({0}, '/tcp') END"
_add("scan", lambda t: rules.scan(_rows(t), LOW), f"""g AS (SELECT win, src, dport, proto, count(DISTINCT dst) AS targets, {_FEW.format('dst', 6)}, {_COMMON} FROM r WHERE proto IN (1, 6, 58) GROUP BY 1, 2, 3, 4)
    SELECT win, 'scan' AS kind, {_SEV} AS sev, src, '' AS dst, {_LABEL.format('dport')} AS port, first_s, last_s, targets, pkts, examples, {_MORE} FROM g
    WHERE wire <= pkts * {LOW.probe_avg} AND targets >= CASE WHEN sampling > 1 THEN {LOW.scan_targets_sampled} ELSE {LOW.scan_targets} END AND seen <= 3 * targets""", "targets", "pkts", "examples", "sampling", "avg")  # fmt: skip
_add("portscan", lambda t: rules.portscan(_rows(t), LOW), f"""g AS (SELECT win, src, dst, count(DISTINCT dport) AS ports, {_FEW.format('dport', 8)}, {_COMMON} FROM r WHERE proto = 6 AND dport < 32768 GROUP BY 1, 2, 3)
    SELECT win, 'portscan' AS kind, {_SEV} AS sev, src, dst, '' AS port, first_s, last_s, ports, pkts, examples, {_MORE} FROM g
    WHERE wire <= pkts * {LOW.probe_avg} AND ports >= CASE WHEN sampling > 1 THEN {LOW.scan_ports_sampled} ELSE {LOW.scan_ports} END AND seen <= 3 * ports""", "ports", "pkts", "examples", "sampling", "avg")  # fmt: skip
_add("brute", lambda t: rules.brute(_rows(t), LOW), f"""g AS (SELECT win, src, dst, dport, count(DISTINCT sport) AS conns, {_COMMON} FROM r WHERE proto = 6 AND dport IN ({', '.join(map(str, rules.LOGIN_PORTS))}) GROUP BY 1, 2, 3, 4)
    SELECT win, 'brute' AS kind, {_SEV} AS sev, src, dst, concat(dport, '/tcp') AS port, first_s, last_s, conns, pkts, {_MORE} FROM g
    WHERE wire <= pkts * CASE WHEN sampling > 1 THEN 200 ELSE {LOW.brute_avg} END AND conns >= CASE WHEN sampling > 1 THEN {LOW.brute_sampled} ELSE {LOW.brute} END AND (sampling <= 1 OR conns >= 0.7 * seen)""", "conns", "pkts", "sampling", "avg")  # fmt: skip
_add("threat", lambda t: rules.threat(_rows(t), LOW), """g AS (SELECT win, client, server, threat, min(dir) AS dir, CAST(coalesce(sum(wire) FILTER (src = client), 0) AS BIGINT) AS up, CAST(coalesce(sum(wire) FILTER (src = server), 0) AS BIGINT) AS down, CAST(sum(flows) AS BIGINT) AS flows, min(t) AS first_s, max(t) + 60 AS last_s FROM r WHERE threat <> '' GROUP BY 1, 2, 3, 4)
    SELECT win, 'threat' AS kind, CASE dir WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS sev, client AS src, server AS dst, threat AS port, first_s, last_s, up, down, flows FROM g""", "up", "down", "flows")  # fmt: skip
_add("fastscan", lambda t: rules.fastscan(_rows(t), LOW), f"""g AS (SELECT win, src, t // 60 * 60 AS minute, count(DISTINCT dst) AS targets, count(DISTINCT dport) AS ports, {_FEW.format('dst', 6)}, {_COMMON} FROM r WHERE proto = 6 GROUP BY 1, 2, 3)
    SELECT win, 'fastscan' AS kind, CASE WHEN own THEN 3 ELSE 2 END AS sev, src, '' AS dst, '' AS port, minute AS first_s, minute + 60 AS last_s, targets, ports, examples, {_MORE} FROM g
    WHERE targets >= {LOW.fast_targets} AND ports >= {LOW.fast_ports} AND wire <= pkts * {LOW.probe_avg}""", "targets", "ports", "examples", "sampling", "avg")  # fmt: skip
_add("beacon", lambda t: rules.beacon(_rows(t), LOW), f"""m AS (SELECT win, client, server, svc_port, proto, t // 60 * 60 AS minute, sum(wire) AS w FROM r WHERE NOT srv_int AND proto IN (6, 17) GROUP BY 1, 2, 3, 4, 5, 6),
    n AS (SELECT *, minute - lag(minute) OVER (PARTITION BY win, client, server, svc_port, proto ORDER BY minute) AS gap FROM m),
    o AS (SELECT *, avg(gap) OVER (PARTITION BY win, client, server, svc_port, proto) AS mean FROM n),
    g AS (SELECT win, client, server, svc_port, proto, count(*) AS checkins, CAST(sum(w) AS BIGINT) AS bytes, max(mean) AS period_s, avg(abs(gap - mean)) / max(mean) AS jitter, min(minute) AS first_s, max(minute) + 60 AS last_s FROM o GROUP BY 1, 2, 3, 4, 5)
    SELECT win, 'beacon' AS kind, 2 AS sev, client AS src, server AS dst, {_LABEL.format('svc_port')} AS port, first_s, last_s, checkins, bytes, round(jitter, 6) AS jitter FROM g
    WHERE checkins >= {LOW.beacon_minutes} AND bytes <= {LOW.beacon_bytes} * checkins AND jitter <= {LOW.beacon_jitter}""", "checkins", "bytes", "jitter")  # fmt: skip
_add("llm", lambda t: rules.model_api(_rows(t), LOW), f"""g AS (SELECT win, client, server, svc_port, min(peer_org) AS org, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT t // 60) AS minutes, min(t) AS first_s, max(t) + 60 AS last_s FROM r
    WHERE NOT srv_int AND dir = 1 AND ({' OR '.join(f"lower(peer_org) LIKE '%{o}%'" for o in LOW.model_orgs)}) GROUP BY 1, 2, 3, 4)
    SELECT win, 'llm' AS kind, 1 AS sev, client AS src, server AS dst, concat(svc_port, '/tcp') AS port, first_s, last_s, org, bytes, minutes FROM g WHERE bytes >= {LOW.model_bytes}""", "org", "bytes", "minutes")  # fmt: skip
_add("flood", lambda t: rules.flood(_rows(t), LOW, t.r_host), f"""{_rollup_sql('r_host', 'ip')}, g AS (SELECT win, dst, count(DISTINCT src) AS sources, {_COMMON} FROM r WHERE wire <= pkts * {LOW.flood_avg} GROUP BY 1, 2 HAVING sum(pkts) >= {LOW.flood_pps * LOW.window}),
    hours AS (SELECT ip, epoch_us(ts) // 1000000 AS hs, sum(coalesce(pkts, 0)) AS hp FROM r_host_1 GROUP BY 1, 2),
    u AS (SELECT win, dst, sum(hp)::DOUBLE / (count(*) * 3600) AS usual FROM g JOIN hours ON dst = ip AND hs >= win - {LOW.window + 7 * 86400} AND hs < win - {LOW.window + 3600} GROUP BY 1, 2)
    SELECT win, 'flood' AS kind, 2 AS sev, '' AS src, dst, @port AS port, first_s, last_s, sources, round(pkts::DOUBLE / {LOW.window}, 6) AS pps, round(coalesce(usual, 0), 6) AS usual, {_MORE} FROM g LEFT JOIN u USING (win, dst) WHERE pkts::DOUBLE / {LOW.window} >= {LOW.flood_ratio} * coalesce(usual, 0)""", "sources", "pps", "usual", "sampling", "avg", summaries=True)  # fmt: skip
_MODE = f"(SELECT {{0}} FROM r m WHERE m.win = g.win AND m.dst = g.dst AND m.wire <= m.pkts * {LOW.flood_avg} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_SQLS["detect_flood"] = _SQLS["detect_flood"].replace("@port", f"CASE WHEN {_MODE.format('proto')} IN (1, 58) THEN 'icmp' WHEN {_MODE.format('proto')} = 17 THEN concat({_MODE.format('dport')}, '/udp') ELSE concat({_MODE.format('dport')}, '/tcp') END")
_ADMIN = ", ".join(map(str, rules.ADMIN_PORTS))
_SIGHT = f"""svc AS (SELECT win, server AS a, '' AS b, svc_port AS port, min(t) AS f, max(t) AS l FROM r WHERE dir = 3 AND proto = 6 AND svc_port IN ({_ADMIN}) GROUP BY 1, 2, 4 HAVING sum(wire) > 250 * sum(pkts)),
    up AS (SELECT win, client AS a, server AS b, 0 AS port, min(t) AS f, max(t) AS l FROM r WHERE dir = 1 GROUP BY 1, 2, 3 HAVING sum(wire) >= 1000000)"""
register("seen_learn", lambda t: rules.learn(None, _rows(t)).select("kind", "a", "b", "port", F.unix_seconds("first_ts").alias("first_s"), F.unix_seconds("last_ts").alias("last_s")), f"""{_W}, {_SIGHT}
    SELECT 'svc' AS kind, a, b, port, min(f) AS first_s, max(l) AS last_s FROM svc GROUP BY 2, 3, 4 UNION ALL SELECT 'up', a, b, port, min(f), max(l) FROM up GROUP BY 2, 3, 4""")  # fmt: skip
_HOPS = f"""{_SIGHT}, known AS (SELECT a, port, min(f) AS since FROM svc GROUP BY 1, 2),
    h AS (SELECT win, client, server, svc_port, sum(wire) AS wire, min(t) AS f, max(t) AS l FROM r WHERE dir = 3 AND proto = 6 AND svc_port IN ({_ADMIN}) GROUP BY 1, 2, 3, 4 HAVING sum(wire) > 250 * sum(pkts)),
    fresh AS (SELECT h.* FROM h LEFT JOIN known ON server = a AND svc_port = port WHERE since IS NULL OR since >= win - 87000),
    hop AS (SELECT * FROM fresh QUALIFY count(*) OVER (PARTITION BY win, server, svc_port) < {LOW.new_service_clients})"""
_add("lateral", lambda t: rules.lateral(_rows(t), LOW), f"""{_HOPS} SELECT win, 'lateral' AS kind, 3 AS sev, client AS src, '' AS dst, concat(svc_port, '/tcp') AS port, min(f) AS first_s, max(l) + 60 AS last_s, count(DISTINCT server) AS hosts, CAST(sum(wire) AS BIGINT) AS bytes FROM hop GROUP BY win, client, svc_port""", "hosts", "bytes")
_add("chain", lambda t: rules.chain(_rows(t), LOW), f"""{_HOPS}, p AS (SELECT i.win, i.client AS a, i.server AS b, o.server AS c, o.svc_port AS op, i.f AS f, o.l AS l FROM hop i JOIN hop o ON i.win = o.win AND i.server = o.client WHERE o.server <> i.client AND o.f >= i.f AND o.f - i.f <= {LOW.chain_within})
    SELECT win, 'chain' AS kind, 3 AS sev, b AS src, arg_min(c, (f, c, op)) AS dst, concat(arg_min(op, (f, c, op)), '/tcp') AS port, min(f) AS first_s, max(l) + 60 AS last_s, count(DISTINCT c) AS onward FROM p GROUP BY win, b""", "onward")  # fmt: skip
_add("exfil", lambda t: rules.exfil(_rows(t), LOW), f"""{_SIGHT}, known AS (SELECT a, b, min(f) AS since FROM up GROUP BY 1, 2),
    g AS (SELECT win, client, server, CAST(coalesce(sum(wire) FILTER (src = client), 0) AS BIGINT) AS up, CAST(coalesce(sum(wire) FILTER (src = server), 0) AS BIGINT) AS down, min(t) AS first_s, max(t) + 60 AS last_s FROM r WHERE dir = 1 GROUP BY 1, 2, 3)
    SELECT win, 'exfil' AS kind, 3 AS sev, client AS src, server AS dst, '' AS port, first_s, last_s, g.up, down FROM g LEFT JOIN known ON client = a AND server = b WHERE g.up >= {LOW.exfil_bytes} AND g.up >= {LOW.exfil_ratio} * down AND (since IS NULL OR since >= win - 87000)""", "up", "down")  # fmt: skip


def _merged(t: Tables) -> DataFrame:
    out = findings.merge(None, findings.packed(rules.threat(_rows(t), LOW)))
    return out.select("kind", "src", "dst", "port", "sev", F.unix_seconds("first").alias("first_s"), F.unix_seconds("last").alias("last_s"), "hits", F.get_json_object("ev", "$.up").cast("long").alias("up"))


register("findings_merged", _merged, f"""{_W}, g AS (SELECT win, client, server, threat, min(dir) AS dir, coalesce(sum(wire) FILTER (src = client), 0) AS up, min(t) AS f, max(t) + 60 AS l FROM r WHERE threat <> '' GROUP BY 1, 2, 3, 4),
    o AS (SELECT *, max(l) OVER (PARTITION BY client, server, threat ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM g),
    i AS (SELECT *, sum(CASE WHEN p IS NULL OR p < f - 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY client, server, threat ORDER BY win) AS k FROM o)
    SELECT 'threat' AS kind, client AS src, server AS dst, threat AS port, max(CASE dir WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END) AS sev, min(f) AS first_s, max(l) AS last_s, count(*) AS hits, CAST(max(up) AS BIGINT) AS up FROM i GROUP BY client, server, threat, k""")  # fmt: skip
_EVERY = " UNION ALL ".join(f"SELECT win, kind, sev, src, dst, port, first_s, last_s FROM ({_SQLS[f'detect_{k}']})" for k in ("scan", "portscan", "brute", "threat", "fastscan", "beacon", "llm", "flood", "lateral", "exfil", "chain"))
_FOUND = ("kind", "src", "dst", "port", "sev", "first_s", "last_s", "hits")


def _found(found: DataFrame) -> DataFrame:
    return found.withColumn("first_s", F.unix_seconds("first")).withColumn("last_s", F.unix_seconds("last")).select(*_FOUND)


def _ran(t: Tables) -> DataFrame:
    return findings.merge(None, findings.run(t.rows(), RUN.start, RUN.end, LOW, r_host=t.r_host))


register(
    "findings_run", lambda t: _ran(t).select("kind", "src", "dst", "port", "sev", F.unix_seconds("first").alias("first_s"), F.unix_seconds("last").alias("last_s"), "hits"),
    f"""WITH every AS ({_EVERY}), o AS (SELECT *, max(last_s) OVER (PARTITION BY kind, src, dst, port ORDER BY win, first_s, last_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM every),
    i AS (SELECT *, sum(CASE WHEN p IS NULL OR p < first_s - {findings.GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY kind, src, dst, port ORDER BY win, first_s, last_s ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT kind, src, dst, port, max(sev) AS sev, min(first_s) AS first_s, max(last_s) AS last_s, count(*) AS hits FROM i GROUP BY kind, src, dst, port, k""", summaries=True,
)
_RUN_SQL = _SQLS["findings_run"]
register("findings_catch_up", lambda t: _found(findings.caught_up(t.rows(), None, RUN.start, RUN.end, LOW, r_host=t.r_host)[0]), _RUN_SQL, summaries=True)
_EDGE = datetime(2026, 3, 10, 1, tzinfo=timezone.utc)
register("findings_select", lambda t: _found(findings.select(_ran(t), RUN.start, _EDGE, limit=100)), f"SELECT * FROM ({_RUN_SQL}) WHERE first_s < {int(_EDGE.timestamp())} ORDER BY sev DESC, last_s DESC, kind, src, dst, port LIMIT 100", summaries=True)
register("report_findings", lambda t: overview.by_severity(_ran(t)), f"SELECT severity, count(sev) AS n FROM (VALUES (3, 'high'), (2, 'medium'), (1, 'low')) v(s, severity) LEFT JOIN ({_RUN_SQL}) ON s = sev GROUP BY 1", summaries=True)


def _closed(t: Tables) -> DataFrame:
    """Findings of threats after those of one address were marked false and the same windows were looked at again."""
    seen = findings.packed(rules.threat(_rows(t), LOW))
    first = findings.merge(None, seen)
    marked = findings.with_status(first, first.where("src < '10.100.0.3'"), findings.FALSE)
    return findings.merge(marked, seen).groupBy("status", "src").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))


_MERGED = _SQLS["findings_merged"]
register("findings_status", _closed, f"SELECT CASE WHEN src < '10.100.0.3' THEN 'false' ELSE 'open' END AS status, src, CASE WHEN src < '10.100.0.3' THEN count(*) ELSE count(DISTINCT (dst, port)) END AS n, CAST(CASE WHEN src < '10.100.0.3' THEN sum(hits) ELSE sum(hits) * 2 END AS BIGINT) AS hits FROM ({_MERGED}) GROUP BY src")
