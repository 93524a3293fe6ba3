"""Registered queries of the decoders and of ingest: flow rows become datagrams or files, these are decoded, and SQL states
what must come out of the rows themselves."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from netloom.core.arrow import rows_mapped
from netloom.core.shared import new_path
from netloom.functions import net
from netloom.operators import health, ingest, ranges
from netloom.plans.tables import clean_flows, once
from netloom.queries_flow import _FLOWS
from netloom.queries_ingest import _REC, NOW, records
from netloom.sources import capture, encode, files, netflow, sflow
from netloom.sources.wire import dispatch

QUERIES, SQL = {}, {}
RATE, PER_DATAGRAM = 10, 16


def register(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = f, sql


# -- records by rule: what every format can hold
_RULE = {
    "id": "arrival_seq", "exporter": "'192.0.2.' || CAST(1 + arrival_seq % 5 AS VARCHAR(3))", "src": "src", "dst": "dst", "src_port": "sport", "dst_port": "dport", "proto": "proto", "tcp_flags": "tcp_flags", "bytes": "bytes", "packets": "pkts",
    "in_if": "in_if % 60000", "out_if": "out_if % 60000", "vlan": "vlan % 4096", "start_ms": "s * 1000", "end_ms": "(s + arrival_seq % 50) * 1000", "reverse_bytes": "arrival_seq % 3 * 100", "reverse_packets": "arrival_seq % 3",
}
_R = "r AS (SELECT {} FROM (SELECT *, epoch_us(ts) // 1000000 AS s FROM (SELECT *, row_number() OVER (PARTITION BY arrival_seq ORDER BY arrived) AS rn FROM hot) WHERE rn = 1 AND ts IS NOT NULL AND bytes > 0 AND pkts > 0 AND (src LIKE '%:%') = (dst LIKE '%:%')))".format(", ".join(f"{v} AS {k}" for k, v in _RULE.items()))


def _flows(spark: SparkSession, folder: str) -> DataFrame:
    hot = spark.read.parquet(f"{folder}/hot.parquet")
    rows = once(hot.where("ts is not null and bytes > 0 and pkts > 0 and (src like '%:%') = (dst like '%:%')"), [c for c in hot.columns if c != "arrived"], ("ts",)).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return rows.selectExpr(*[f"{v} AS {k}" for k, v in _RULE.items()])


def _datagrams(rows: DataFrame, build: Callable[[list[dict], int], bytes], intro: Callable[[int], bytes] | None = None) -> DataFrame:
    """Datagrams of up to PER_DATAGRAM records of an exporter each, numbered by their first record; intro: one before them."""
    part = rows.groupBy("exporter", F.expr(f"id div {PER_DATAGRAM * 5}").alias("g")).agg(F.sort_array(F.collect_list(F.struct(*["id", *[c for c in rows.columns if c not in ("id", "exporter")]]))).alias("rs"))

    def each(r: dict) -> list[dict]:
        secs = max(x["end_ms"] for x in r["rs"]) // 1000 + 1
        base = {"exporter": r["exporter"], "arrived": None}
        return [base | {"payload": build(r["rs"], secs), "secs": secs, "arrival_seq": r["rs"][0]["id"] + 10}]

    out = rows_mapped(part, each, "payload binary, exporter string, secs long, arrival_seq long")
    out = out.select("payload", "exporter", F.timestamp_seconds("secs").alias("arrived"), "arrival_seq")
    if intro is None:
        return out
    first = [(bytearray(intro(0)), f"192.0.2.{k}", 0) for k in range(1, 6)]
    return out.unionByName(rows.sparkSession.createDataFrame(first, "payload binary, exporter string, arrival_seq long").withColumn("arrived", F.timestamp_seconds(F.lit(0))))


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("exporter", "src", "dst", "src_port", "dst_port", "proto", "tcp_flags", "bytes", "packets", "in_if", "out_if", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "sampling", "sampling_known", *more)


_COLS = "exporter, src, dst, src_port, dst_port, proto, tcp_flags, bytes, packets, in_if, out_if, start_ms, end_ms"
register("source_nf5", lambda s, d: _shown(netflow.records(_datagrams(_flows(s, d).where("src not like '%:%'"), lambda rs, secs: encode.nf5(rs, secs, rate=RATE)))),
         f"WITH {_R} SELECT {_COLS}, {RATE} AS sampling, true AS sampling_known FROM r WHERE src NOT LIKE '%:%'")


def _messages(spark: SparkSession, folder: str, version: int, reverse: bool = False) -> DataFrame:
    build = lambda rs, secs: encode.message(version, encode.data_sets(version, rs, secs, reverse=reverse), secs)
    return _datagrams(_flows(spark, folder), build, lambda secs: encode.message(version, encode.templates(version, reverse, RATE), secs))


for _v, _n in ((9, "nf9"), (10, "ipfix")):
    register(f"source_{_n}", lambda s, d, v=_v: _shown(netflow.records(_messages(s, d, v)), "vlan", "mult"),
             f"WITH {_R} SELECT {_COLS}, {RATE} AS sampling, true AS sampling_known, vlan, {RATE}.0::DOUBLE AS mult FROM r")
_BACK = "exporter, dst AS src, src AS dst, dst_port AS src_port, src_port AS dst_port, proto, tcp_flags, reverse_bytes AS bytes, reverse_packets AS packets, out_if AS in_if, in_if AS out_if, start_ms, end_ms"
register("source_ipfix_both_ways", lambda s, d: _shown(netflow.records(_messages(s, d, 10, True))),
         f"WITH {_R} SELECT {_COLS}, {RATE} AS sampling, true AS sampling_known FROM r UNION ALL SELECT {_BACK}, {RATE}, true FROM r WHERE reverse_packets > 0")
register("source_record_numbers", lambda s, d: netflow.records(_messages(s, d, 10, True)).agg(F.count("*").alias("records"), F.count_distinct("arrival_seq").alias("numbers")),
         f"WITH {_R} SELECT count(*) + count(*) FILTER (reverse_packets > 0) AS records, count(*) + count(*) FILTER (reverse_packets > 0) AS numbers FROM r")


def _damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Datagrams of which every seventh is cut short."""
    g = _datagrams(_flows(spark, folder).where("src not like '%:%'"), lambda rs, secs: encode.nf5(rs, secs))
    return netflow.records5(g.withColumn("payload", F.when(F.col("arrival_seq") % 7 == 0, F.substring("payload", 1, 40)).otherwise(F.col("payload"))))


_G = f"g AS (SELECT exporter, id // {PER_DATAGRAM * 5} AS g, min(id) + 10 AS n, count(*) AS c FROM r WHERE src NOT LIKE '%:%' GROUP BY 1, 2)"
register("source_quarantine", lambda s, d: _damaged(s, d).groupBy("exporter").agg(F.count("error").alias("broken"), F.count(F.when(F.col("error").isNull(), 1)).alias("records")),
         f"WITH {_R}, {_G} SELECT exporter, count(*) FILTER (n % 7 = 0) AS broken, CAST(coalesce(sum(c) FILTER (n % 7 <> 0), 0) AS BIGINT) AS records FROM g GROUP BY 1")

# -- sFlow: one sampled frame per row; counters of ifc
_FRAMED = "proto IN (6, 17) AND src_port NOT IN (4789, 6081) AND dst_port NOT IN (4789, 6081)"


def _sampled(spark: SparkSession, folder: str) -> DataFrame:
    def build(rs: list[dict], secs: int) -> bytes:
        return encode.sflow("10.9.9.9", [encode.flow_sample(r, 64 + r["id"] % 1400, RATE) for r in rs])

    return sflow.samples(_datagrams(_flows(spark, folder).where(_FRAMED), build))


register("source_sflow", lambda s, d: sflow.records(sflow.once(_sampled(s, d))).select("exporter", "src", "dst", "src_port", "dst_port", "proto", "tcp_flags", "vlan", "in_if", "out_if", "bytes", "packets", "l2", "l2_hdr", "sampling", "mult"),
         f"WITH {_R} SELECT '10.9.9.9' AS exporter, src, dst, src_port, dst_port, proto, CASE WHEN proto = 6 THEN tcp_flags ELSE 0 END AS tcp_flags, vlan, in_if, out_if, 64 + id % 1400 AS bytes, 1 AS packets, true AS l2, CASE WHEN vlan > 0 THEN 18 ELSE 14 END AS l2_hdr, {RATE} AS sampling, {RATE}.0::DOUBLE AS mult FROM r WHERE {_FRAMED}")
register("source_sflow_twice", lambda s, d: sflow.once(_sampled(s, d).unionByName(_sampled(s, d).withColumn("arrival_seq", F.col("arrival_seq") + 1_000_000_000))).groupBy("kind").agg(F.count("*").alias("n")),
         f"WITH {_R} SELECT 'flow' AS kind, count(*) AS n FROM r WHERE {_FRAMED}")


def _counters(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/ifc.parquet").where("ifindex is not null and in_oct >= 0 and out_oct >= 0 and in_pkts between 0 and 4294967295 and out_pkts between 0 and 4294967295 and ts is not null")
    rows = rows.select("ifindex", F.greatest(F.coalesce("speed", F.lit(0)), F.lit(0)).alias("speed"), "in_oct", "out_oct", "in_pkts", "out_pkts", "ts")

    def each(r: dict) -> list[dict]:
        return [{"payload": encode.sflow("10.9.9.9", [encode.counter_sample(r)]), "arrived": r["ts"], "arrival_seq": 1}]

    return sflow.counters(sflow.samples(rows_mapped(rows, each, "payload binary, arrived timestamp, arrival_seq long")))


register("source_sflow_counters", lambda s, d: _counters(s, d).select(F.unix_micros("ts").alias("us"), "ifindex", "speed", "in_oct", "out_oct", "in_pkts", "out_pkts"),
         "SELECT epoch_us(ts) AS us, ifindex, greatest(coalesce(speed, 0), 0) AS speed, in_oct, out_oct, in_pkts, out_pkts FROM ifc WHERE ifindex IS NOT NULL AND in_oct >= 0 AND out_oct >= 0 AND in_pkts BETWEEN 0 AND 4294967295 AND out_pkts BETWEEN 0 AND 4294967295 AND ts IS NOT NULL")


# -- capture files, one for an hour's worth of records
def _packets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _flows(spark, folder).where(_FRAMED)
    part = rows.groupBy(F.expr("start_ms div 3600000").alias("h"), F.expr("id % 8").alias("k")).agg(F.sort_array(F.collect_list(F.struct("start_ms", "id", *[c for c in rows.columns if c not in ("start_ms", "id")]))).alias("rs"))

    def each(r: dict) -> list[dict]:
        return [{"path": f"{r['h']}/{r['k']}", "content": encode.capture_file((x["start_ms"] * 1000, encode.frame(x), 100 + x["id"] % 1400) for x in r["rs"])}]

    return capture.packets_in(rows_mapped(part, each, "path string, content binary"))


register("source_capture", lambda s, d: _packets(s, d).select("us", "src", "dst", "src_port", "dst_port", "proto", "vlan", "wire"),
         f"WITH {_R} SELECT start_ms * 1000 AS us, src, dst, src_port, dst_port, proto, vlan, 100 + id % 1400 + 4 AS wire FROM r WHERE {_FRAMED}")
_SESSION = "PARTITION BY start_ms // 3600000, id % 8, src, dst, src_port, dst_port, proto, vlan"
register("source_capture_flows", lambda s, d: capture.flows(_packets(s, d)).select("src", "dst", "src_port", "dst_port", "proto", "vlan", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "packets", "bytes"),
         f"""WITH {_R}, p AS (SELECT *, start_ms - lag(start_ms) OVER ({_SESSION} ORDER BY start_ms, id) AS gap FROM r WHERE {_FRAMED}),
    n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {capture.IDLE_US // 1000} THEN 1 ELSE 0 END) OVER ({_SESSION} ORDER BY start_ms, id) AS session FROM p),
    f AS (SELECT *, min(start_ms) OVER ({_SESSION}, session) AS s0 FROM n)
    SELECT src, dst, src_port, dst_port, proto, vlan, min(start_ms) AS start_ms, max(start_ms) AS end_ms, count(*) AS packets, CAST(sum(100 + id % 1400 + 4) AS BIGINT) AS bytes FROM f
    GROUP BY start_ms // 3600000, id % 8, src, dst, src_port, dst_port, proto, vlan, session, (start_ms - s0) // {capture.ACTIVE_US // 1000}""")  # fmt: skip

# -- ingest: clocks, plausibility, tunnels, locality, threats
_CLOCK = "(e_us + (arrival_seq % 9 - 4) * 3600000000)"


def _clocked(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder).withColumn("arrived", F.expr("end + make_dt_interval(0, arrival_seq % 9 - 4)"))
    return ingest.corrected_times(rows).select("arrival_seq", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


register("ingest_clock", _clocked, f"""WITH {_REC}, a AS (SELECT *, {_CLOCK} AS came FROM rec)
    SELECT arrival_seq, CASE WHEN e_us > came + 120000000 OR e_us < came - 10800000000 THEN came - (e_us - s_us) ELSE s_us END AS start_us, CASE WHEN e_us > came + 120000000 OR e_us < came - 10800000000 THEN came ELSE e_us END AS end_us FROM a""")  # fmt: skip
_ODD = "CASE arrival_seq % 40 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"


def _odd(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    odd = lambda a, b, c: F.expr(_ODD.format(a=a, b=b, c=c))
    return rows.withColumn("mult", odd("CAST(33554432 AS DOUBLE)", "mult", "mult")).withColumn("bytes", odd("bytes", "packets * 600000", "bytes")).withColumn("src", F.when(F.col("arrival_seq") % 40 == 2, "nowhere").otherwise(F.col("src")))


register("ingest_refused", lambda s, d: ingest.refused(_odd(s, d), NOW), f"""WITH {_REC} SELECT exporter, count(*) AS n FROM rec WHERE arrival_seq % 40 = 0 OR arrival_seq % 40 = 1 AND packets > 0 OR arrival_seq % 40 = 2 GROUP BY 1""")
_TUNNEL = "CASE arrival_seq % 12 WHEN 0 THEN 47 WHEN 1 THEN 4 WHEN 2 THEN 41 ELSE 17 END"
_TUNNEL_PORT = "CASE arrival_seq % 12 WHEN 3 THEN 4789 WHEN 4 THEN 6081 ELSE dst_port END"
register("ingest_encap", lambda s, d: records(s, d).withColumn("proto", F.expr(_TUNNEL).cast("short")).withColumn("dst_port", F.expr(_TUNNEL_PORT)).select("arrival_seq", net.encap_from_tuple().alias("encap")),
         f"""WITH {_REC}, x AS (SELECT *, {_TUNNEL} AS p, {_TUNNEL_PORT} AS q FROM rec) SELECT arrival_seq, CASE WHEN coalesce(encap, 0) <> 0 THEN encap WHEN p = 47 THEN 1 WHEN p = 4 THEN 2
         WHEN p = 41 THEN CASE WHEN src LIKE '%:%' THEN 4 ELSE 3 END WHEN q = 4789 THEN 5 WHEN q = 6081 THEN 6 ELSE 0 END AS encap FROM x""")  # fmt: skip
_SPECIAL = [(167772160, 184549375), (2886729728, 2887778303), (3232235520, 3232301055), (1681915904, 1686110207), (2130706432, 2147483647), (2851995648, 2852061183)]
_INSIDE = "(" + " OR ".join(f"{{0}} BETWEEN {a} AND {b}" for a, b in _SPECIAL) + ")"


def _localities(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean_flows(spark.read.parquet(f"{folder}/hot.parquet")).where("cli4 <> 0 and srv4 <> 0").select("client", "server").distinct()
    rows = rows.withColumn("ck", net.address_key(F.col("client"))).withColumn("sk", net.address_key(F.col("server")))
    rows = rows.withColumn("cli_int", net.special(F.col("ck"))).withColumn("srv_int", net.special(F.col("sk")))
    return rows.select("client", "server", "cli_int", "srv_int", net.direction(F.col("cli_int"), F.col("srv_int")).alias("dir"))


register("ingest_locality", _localities, f"""WITH {_FLOWS}, x AS (SELECT DISTINCT client, server, {_INSIDE.format('cli4')} AS cli_int, {_INSIDE.format('srv4')} AS srv_int FROM flows WHERE cli4 <> 0 AND srv4 <> 0)
    SELECT client, server, cli_int, srv_int, CASE WHEN cli_int AND srv_int THEN 3 WHEN cli_int THEN 1 WHEN srv_int THEN 2 ELSE 4 END AS dir FROM x""")  # fmt: skip
_LISTS = {"watch": "10.100.0.1\n10.66.1.10 # two\n", "ranges": "10.100.0.0/28\n; none\n203.0.113.0/24\n240.0.0.0/4\n", "late": "10.100.0.0/16\n10.100.0.2"}


def _threats(spark: SparkSession, folder: str) -> DataFrame:
    servers = clean_flows(spark.read.parquet(f"{folder}/hot.parquet")).where("cli4 <> 0").select(F.col("client").alias("addr"))
    return ranges.first_listed(servers, files.threat_list(spark, _LISTS), ["list"])


register("threat_match", _threats, """WITH a AS (SELECT DISTINCT client AS addr, cli4 AS n FROM hot WHERE ts IS NOT NULL AND cli4 <> 0),
    x(lo, hi, i, list) AS (VALUES (174325761, 174325761, 0, 'watch'), (172097802, 172097802, 1, 'watch'), (174325760, 174325775, 2, 'ranges'), (3405803776, 3405804031, 3, 'ranges'), (4026531840, 4294967295, 4, 'ranges'), (174325760, 174391295, 5, 'late'), (174325762, 174325762, 6, 'late'))
    SELECT addr, list FROM a JOIN x ON n BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY addr ORDER BY CASE WHEN lo = hi THEN 0 ELSE 1 END, i) = 1""")  # fmt: skip
register("blocked_exporters", lambda s, d: files.not_blocked(_flows(s, d), s.createDataFrame([("192.0.2.1",), ("192.0.2.9",)], "addr string")).groupBy("exporter").agg(F.count("*").alias("n")), f"WITH {_R} SELECT exporter, count(*) AS n FROM r WHERE exporter <> '192.0.2.1' GROUP BY 1")
register("threat_list_sizes", lambda s, d: files.list_sizes(files.threat_list(s, _LISTS)), "SELECT * FROM (VALUES ('watch', 2::BIGINT), ('ranges', 3::BIGINT), ('late', 2::BIGINT)) v(list, entries)")


def _asn_file(spark: SparkSession, folder: str) -> DataFrame:
    """A file of AS ranges, one /16 per supplier, with lines that say nothing."""
    rows = spark.read.parquet(f"{folder}/supplier.parquet")
    line = F.expr("concat('10.', s_suppkey % 256, '.0.0\t10.', s_suppkey % 256, '.255.255\t', CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 64500 + s_suppkey END, '\t', CASE WHEN s_suppkey % 4 = 0 THEN 'None' ELSE 'DE' END, '\t', s_name)")
    path = new_path(spark, "asn")
    rows.select(line.alias("value")).unionByName(spark.createDataFrame([("# no range",), ("x\ty\t5\tDE\tnone",), ("10.0.0.0\t2001:db8::\t5\tDE\tmixed",)], "value string")).write.text(path)
    return files.asn_ranges(spark, path)


register("asn_file", lambda s, d: _asn_file(s, d).select("lo", "hi", "asn", "cc", "org"), """SELECT printf('40a%02x0000', s_suppkey % 256) AS lo, printf('40a%02xffff', s_suppkey % 256) AS hi, 64500 + s_suppkey AS asn, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'DE' END AS cc, s_name AS org FROM supplier WHERE s_suppkey % 9 <> 0""")
_INVENTORY = "\n".join(f"device 10.66.0.{k} edge {k} room=r{k % 2} {'rack=a_1' if k % 3 else ''}" for k in range(1, 7)) + "\ndevice 10.66.0.99 spare\n# end"
register("racks", lambda s, d: files.Inventory.parse(_INVENTORY).racks(s, clean_flows(s.read.parquet(f"{d}/hot.parquet")).groupBy("exporter").agg(F.sum("wire").alias("wire"))),
         f"""WITH {_FLOWS} SELECT concat('r', k % 2) AS room, CASE WHEN k % 3 = 0 THEN '' ELSE 'a 1' END AS rack, concat('10.66.0.', k) AS exporter, concat('edge ', k) AS device, CAST(coalesce(sum(wire), 0) AS BIGINT) AS wire
    FROM range(1, 7) x(k) LEFT JOIN flows ON exporter = concat('10.66.0.', k) GROUP BY k""")  # fmt: skip

# -- health: sources made from the flow rows by rule
_STATE = {"pending": "n % 3", "assumed": "n % 4 = 0", "received": "n", "lost": "n % 5", "drops": "n % 2", "no_template": "n % 7 - 1", "skew_s": "n % 300", "errors": "0"}


def _health(spark: SparkSession, folder: str) -> DataFrame:
    n = clean_flows(spark.read.parquet(f"{folder}/hot.parquet")).groupBy("exporter").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n"))
    sources = n.select("exporter", "last_seen", *[F.expr(v).alias(k) for k, v in _STATE.items()])
    return health.source_health(sources, datetime(2026, 3, 10, 2, tzinfo=timezone.utc)).select("exporter", F.array_join("codes", ",").alias("codes"))


register("health_codes", _health, f"""WITH {_FLOWS}, n AS (SELECT exporter, max(epoch_us(ts)) // 1000000 AS at_s, count(*) AS n FROM flows GROUP BY 1), x AS (SELECT exporter, at_s, {', '.join(f'{v} AS {k}' for k, v in _STATE.items())} FROM n)
    SELECT exporter, concat_ws(',', CASE WHEN at_s < {int(datetime(2026, 3, 10, 2, tzinfo=timezone.utc).timestamp())} - 300 THEN 'silent' END, CASE WHEN pending > 0 THEN 'waiting_sampling' END, CASE WHEN assumed THEN 'assumed_unsampled' END, CASE WHEN lost > 0.01 * (received + lost) THEN 'loss' END,
      CASE WHEN drops > 0 THEN 'agent_drops' END, CASE WHEN no_template > 0 THEN 'no_template' END, CASE WHEN abs(skew_s) > 120 THEN 'clock_skew' END, CASE WHEN errors > 0 THEN 'decode_errors' END) AS codes FROM x""")  # fmt: skip
register("metrics_text", lambda s, d: health.metrics_text(clean_flows(s.read.parquet(f"{d}/hot.parquet")).groupBy("exporter").agg(F.sum("wire").cast("double").alias("value")).select(F.lit("wire_total").alias("name"), F.create_map(F.lit("exporter"), F.col("exporter")).alias("labels"), "value")),
         f"WITH {_FLOWS} SELECT concat('wire_total{{exporter=\"', exporter, '\"}} ', CAST(sum(wire) AS BIGINT)) AS line FROM flows GROUP BY exporter")


def _rates(spark: SparkSession, folder: str) -> DataFrame:
    per = clean_flows(spark.read.parquet(f"{folder}/hot.parquet")).groupBy("exporter", F.unix_seconds("ts").alias("at")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("exporter").orderBy("at")
    return health.rates(per.select("exporter", "at", F.sum("n").over(w).alias("records"))).select("exporter", "at", F.round("rate", 6).alias("rate"))


register("health_rates", _rates, f"""WITH {_FLOWS}, p AS (SELECT exporter, epoch_us(ts) // 1000000 AS at_s, count(*) AS n FROM flows GROUP BY 1, 2),
    r AS (SELECT exporter, at_s, n::DOUBLE / (at_s - lag(at_s) OVER (PARTITION BY exporter ORDER BY at_s)) AS r FROM p),
    i AS (SELECT *, row_number() OVER (PARTITION BY exporter ORDER BY at_s) AS i FROM r WHERE r IS NOT NULL)
    SELECT a.exporter, a.at_s AS "at", round(sum(b.r * CASE WHEN b.i = greatest(1, a.i - 15) THEN 0.4::DOUBLE ** (a.i - b.i) ELSE 0.6::DOUBLE * 0.4::DOUBLE ** (a.i - b.i) END), 6) AS rate
    FROM i a JOIN i b ON a.exporter = b.exporter AND b.i BETWEEN greatest(1, a.i - 15) AND a.i GROUP BY 1, 2""")  # fmt: skip
_STARTS = (b"\0\0\0\5", b"\0\5", b"\0\x09", b"\0\x0a", b"GET /", b"\0")
register("source_dispatch", lambda s, d: rows_mapped(_flows(s, d).select("id"), lambda r: [{"kind": dispatch(_STARTS[r["id"] % 6])}], "kind string").groupBy("kind").agg(F.count("*").alias("n")),
         f"WITH {_R} SELECT ['sflow', 'nf5', 'nf9', 'ipfix', '', ''][1 + id % 6] AS kind, count(*) AS n FROM r GROUP BY 1")
