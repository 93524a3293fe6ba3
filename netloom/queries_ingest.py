"""Registered ingest queries: records made from flow rows by a fixed rule that both engines share."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom import queries_flow
from netloom.core.shared import new_path
from netloom.functions import net
from netloom.maintain import store
from netloom.operators import ingest, interfaces, ranges, rollups
from netloom.plans.tables import Tables, clean_flows, once

NOW = datetime(2026, 7, 1)
_RULE = {
    "s_us": "us + (arrival_seq % 60) * 1000000", "e_us": "us + (arrival_seq % 60) * 1000000 + (arrival_seq * 7 % 400) * 1000000", "src": "src", "dst": "dst", "src_port": "sport", "dst_port": "dport", "proto": "proto",
    "tcp_flags": "tcp_flags", "bytes": "coalesce(bytes, 0)", "packets": "pkts", "l2": "arrival_seq % 3 = 0", "l2_hdr": "CASE WHEN arrival_seq % 5 = 0 THEN 14 ELSE 0 END", "mult": "1.0 + arrival_seq % 4",
    "in_if": "in_if", "out_if": "out_if", "vlan": "vlan", "encap": "encap", "direction": "CASE arrival_seq % 3 WHEN 2 THEN 255 ELSE arrival_seq % 3 END", "opener": "0", "exporter": "exporter", "observation": "CASE WHEN arrival_seq % 4 = 0 THEN in_if ELSE 0 END",
    "source": "src_type", "arrival_seq": "arrival_seq",
}
_SQL_RULE = ", ".join(f"{v} AS {k}" for k, v in _RULE.items()).replace("1.0 + arrival_seq % 4", "1.0::DOUBLE + arrival_seq % 4")
_REC = f"rec AS (SELECT {_SQL_RULE} FROM (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY arrival_seq ORDER BY arrived) AS rn FROM hot) WHERE rn = 1 AND ts IS NOT NULL)"


def records(spark: SparkSession, folder: str) -> DataFrame:
    hot = spark.read.parquet(f"{folder}/hot.parquet")
    rows = once(hot, [c for c in hot.columns if c != "arrived"]).where("ts is not null").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.selectExpr(*[f"{v} AS {k}" for k, v in _RULE.items()])
    rows = rows.withColumn("start", F.timestamp_micros("s_us")).withColumn("end", F.timestamp_micros("e_us")).drop("s_us", "e_us").withColumn("mult", F.col("mult").cast("double"))
    more = {"tos": "short", "sampling": "long", "src_as": "long", "dst_as": "long", "domain": "long"}
    return rows.select("*", F.lit(True).alias("sampling_known"), *[F.lit(0).cast(t).alias(c) for c, t in more.items()])


QUERIES, SQL = {}, {}


def register(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


_NORMAL = """norm AS (SELECT *, packets * mult AS p, bytes * mult AS b, CASE WHEN l2_hdr <> 0 THEN l2_hdr + 4.0::DOUBLE WHEN vlan <> 0 THEN 22.0::DOUBLE ELSE 18.0::DOUBLE END AS head, CASE WHEN vlan <> 0 THEN 22.0::DOUBLE ELSE 18.0::DOUBLE END AS put FROM rec),
    scaled AS (SELECT *, CASE WHEN l2 THEN greatest(0, b - p * head) ELSE b END AS l3, CASE WHEN l2 THEN b ELSE b + p * put END AS wire FROM norm)"""
register("l2_normalise", lambda s, d: ingest.normalised(records(s, d)).select("arrival_seq", "l3", "wire", F.col("pkts").alias("p")), f"WITH {_REC}, {_NORMAL} SELECT arrival_seq, l3, wire, p FROM scaled")
_PASSED = "(CASE WHEN s_us >= e_us THEN 1.0::DOUBLE ELSE greatest(0, (least({0}, e_us) - s_us)::DOUBLE / (e_us - s_us)) END)"
_SLICES = f"""cut AS (SELECT *, CASE WHEN s_us >= e_us THEN e_us // 60000000 * 60000000 ELSE s_us // 60000000 * 60000000 END AS m0, CASE WHEN s_us >= e_us THEN e_us // 60000000 * 60000000 ELSE (e_us - 1) // 60000000 * 60000000 END AS m1 FROM scaled),
    each AS (SELECT *, unnest(range(m0, m1 + 1, 60000000)) AS m FROM cut), part AS (SELECT *, CASE WHEN m = m1 THEN 1.0::DOUBLE ELSE {_PASSED.format('m + 60000000')} END AS upto, CASE WHEN m <= s_us OR s_us >= e_us THEN 0.0::DOUBLE ELSE {_PASSED.format('m')} END AS before FROM each)"""
register(
    "counter_shares", lambda s, d: ingest.minute_slices(ingest.normalised(records(s, d)).withColumnsRenamed({"wire": "_w", "pkts": "_p"}), NOW, {"l3": "b", "_w": "wire", "_p": "pkts"}).select("arrival_seq", F.unix_seconds("ts").alias("ts_s"), "flows", "b", "wire", "pkts"),
    f"""WITH {_REC}, {_NORMAL}, {_SLICES} SELECT arrival_seq, m // 1000000 AS ts_s, CASE WHEN m = m1 THEN 1 ELSE 0 END AS flows, CAST(round(l3 * upto) - round(l3 * before) AS BIGINT) AS b, CAST(round(wire * upto) - round(wire * before) AS BIGINT) AS wire, CAST(round(p * upto) - round(p * before) AS BIGINT) AS pkts FROM part""",
)
register("minute_slices", lambda s, d: ingest.minute_slices(records(s, d), NOW, {}).groupBy(F.unix_seconds("ts").alias("ts_s")).agg(F.count("*").alias("slices"), F.sum("flows").alias("ended")), f"WITH {_REC}, {_NORMAL}, {_SLICES} SELECT m // 1000000 AS ts_s, count(*) AS slices, CAST(sum(CASE WHEN m = m1 THEN 1 ELSE 0 END) AS BIGINT) AS ended FROM part GROUP BY 1")
_known = lambda p: f"((proto = 6 AND {p} IN ({', '.join(map(str, net.TCP_SERVICES))})) OR (proto = 17 AND {p} IN ({', '.join(map(str, net.UDP_SERVICES))})))"
_CLIENT = f"""CASE WHEN proto NOT IN (6, 17, 132) THEN true WHEN proto = 6 AND packets = 1 AND tcp_flags & 18 = 2 THEN true WHEN proto = 6 AND packets = 1 AND tcp_flags & 18 = 18 THEN false
    WHEN {_known('dst_port')} AND NOT {_known('src_port')} THEN true WHEN {_known('src_port')} AND NOT {_known('dst_port')} THEN false ELSE dst_port <= src_port END"""
_case = lambda t: "CASE svc " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in t.items()) + " END"
_APP = f"CASE WHEN proto NOT IN (6, 17, 132) THEN CASE proto {' '.join(f'WHEN {p} THEN {chr(39)}{n}{chr(39)}' for p, n in net.PROTOCOL_NAMES.items())} ELSE CAST(proto AS VARCHAR) END ELSE coalesce(CASE proto WHEN 6 THEN {_case(net.TCP_SERVICES)} WHEN 17 THEN {_case(net.UDP_SERVICES)} END, concat(CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'SCTP' END, '/', svc)) END"


def _roles(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder).withColumn("c", net.source_is_client())
    svc = F.when(net.ports_matter(F.col("proto")), F.when(F.col("c"), F.col("dst_port")).otherwise(F.col("src_port"))).otherwise(0)
    return rows.select("arrival_seq", F.when(F.col("c"), F.col("src")).otherwise(F.col("dst")).alias("client"), svc.cast("int").alias("svc"), net.app_name(F.col("proto"), svc).alias("app"))


register("role_inference", _roles, f"""WITH {_REC}, c AS (SELECT *, {_CLIENT} AS c FROM rec), v AS (SELECT *, CASE WHEN proto IN (6, 17, 132) THEN CASE WHEN c THEN dst_port ELSE src_port END ELSE 0 END AS svc FROM c)
    SELECT arrival_seq, CASE WHEN c THEN src ELSE dst END AS client, svc, {_APP} AS app FROM v""")  # fmt: skip

# -- address lookups: ranges and networks made from the dimension tables by rule, /16s of suppliers within /12s of nations
_BASE = 240 << 24


def _asns(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    key = lambda n: F.concat(F.lit("4"), F.lower(F.hex(n)))
    lo = F.lit(_BASE) + F.col("s_suppkey") * 37 % 4096 * 65536
    fine = t("supplier").select(key(lo).alias("lo"), key(lo + 65535).alias("hi"), F.lit(0).alias("source"), (64500 + F.col("s_suppkey")).alias("asn"), F.lit("SU").alias("cc"), F.col("s_name").alias("org"))
    lo = F.lit(_BASE) + F.col("n_nationkey").cast("long") * 10 % 256 * 1048576
    wide = t("nation").select(key(lo).alias("lo"), key(lo + 1048575).alias("hi"), F.lit(1).alias("source"), (100 + F.col("n_nationkey")).cast("long").alias("asn"), F.lit("NA").alias("cc"), F.col("n_name").alias("org"))
    return fine.unionByName(wide)


def _peers(spark: SparkSession, folder: str) -> DataFrame:
    return clean_flows(spark.read.parquet(f"{folder}/hot.parquet")).select(F.col("server").alias("addr"))


_SERVERS = "servers AS (SELECT DISTINCT server AS addr, srv4 AS n FROM hot WHERE ts IS NOT NULL AND srv4 <> 0)"
register("asn_range_join", lambda s, d: ranges.asn_of(_peers(s, d), _asns(s, d)), f"""WITH {_SERVERS}, x AS (
      SELECT {_BASE}::BIGINT + s_suppkey * 37 % 4096 * 65536 AS lo, {_BASE}::BIGINT + s_suppkey * 37 % 4096 * 65536 + 65535 AS hi, 0 AS source, 64500 + s_suppkey AS asn, 'SU' AS cc, s_name AS org FROM supplier
      UNION ALL SELECT {_BASE}::BIGINT + n_nationkey * 10 % 256 * 1048576, {_BASE}::BIGINT + n_nationkey * 10 % 256 * 1048576 + 1048575, 1, 100 + n_nationkey, 'NA', n_name FROM nation)
    SELECT addr, asn, cc, org FROM servers JOIN x ON n BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY addr ORDER BY source, lo DESC, asn, cc, org) = 1""")  # fmt: skip
_NETS = [("10.0.0.0/8", "all"), ("10.100.0.0/16", "campus"), ("10.66.0.0/16", "core"), ("10.66.1.0/24", "racks"), ("10.66.0.0/16", "core again"), ("240.0.0.0/4", "outside"), *[(f"10.100.{i}.0/24", f"floor {i}") for i in range(12)], ("2001:db8::/32", "six"), ("2001:db8:1000::/36", "six narrow")]
_NET_ROWS = ", ".join(f"({int(lo[1:], 16)}, {int(hi[1:], 16)}, {i}, '{n}')" for i, (c, n) in enumerate(_NETS) for lo, hi in [ranges.network_bounds(c)] if lo[0] == "4")
register("lpm_segment", lambda s, d: ranges.longest_prefix(_peers(s, d).where("addr not like '%:%'"), ranges.networks(s, _NETS, "name string"), ["name"]), f"""WITH {_SERVERS}, x(lo, hi, i, name) AS (VALUES {_NET_ROWS})
    SELECT addr, name FROM servers JOIN x ON n BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY addr ORDER BY hi - lo, i) = 1""")  # fmt: skip

# -- duplicates
_KEYS = "m, src, dst, src_port, dst_port, proto"


def _dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder).withColumn("ts", F.date_trunc("hour", "start")).withColumnsRenamed({"src_port": "sport", "dst_port": "dport"})
    return ingest.mark_duplicates(rows.withColumn("src", F.lit("a")).withColumn("dst", F.lit("b"))).select("arrival_seq", "dup")


register("dedup", _dedup, f"""WITH {_REC}, k AS (SELECT *, s_us // 3600000000 AS m FROM rec), f AS (SELECT *, first_value({{'e': exporter, 'o': observation, 'i': in_if, 'x': out_if, 'd': direction}}) OVER (PARTITION BY m, src_port, dst_port, proto ORDER BY arrival_seq) AS first FROM k)
    SELECT arrival_seq, first <> {{'e': exporter, 'o': observation, 'i': in_if, 'x': out_if, 'd': direction}} AS dup FROM f""")  # fmt: skip
register("promote_dup", lambda s, d: store.promoted(clean_flows(s.read.parquet(f"{d}/hot.parquet")).where("exporter <> '10.66.0.1'")).groupBy("exporter").agg(F.count("*").alias("rows"), F.sum(F.col("dup").cast("long")).alias("dups")), """WITH f AS (SELECT * REPLACE (coalesce(dup, false) AS dup) FROM (SELECT *, row_number() OVER (PARTITION BY arrival_seq ORDER BY arrived) AS rn FROM hot) WHERE rn = 1 AND ts IS NOT NULL AND exporter <> '10.66.0.1'),
    g AS (SELECT exporter, dup, bool_or(NOT dup) OVER (PARTITION BY ts, src, dst, sport, dport, proto) AS has, row_number() OVER (PARTITION BY ts, src, dst, sport, dport, proto ORDER BY exporter, in_if, out_if, wire, pkts) AS n FROM f)
    SELECT exporter, count(*) AS rows, CAST(sum((dup AND (has OR n > 1))::INT) AS BIGINT) AS dups FROM g GROUP BY 1""")  # fmt: skip
_SHARES = "CAST(round(l3 * upto) - round(l3 * before) AS BIGINT) AS bytes, CAST(round(wire * upto) - round(wire * before) AS BIGINT) AS wire, CAST(round(p * upto) - round(p * before) AS BIGINT) AS pkts, CASE WHEN m = m1 THEN 1 ELSE 0 END AS flows"
_POINT = "{'e': exporter, 'o': observation, 'i': in_if, 'x': out_if, 'd': direction}"
register(
    "ingest_rows", lambda s, d: ingest.flow_rows(records(s, d), NOW, ranges.networks(s, _NETS, "name string"), _asns(s, d)).select("arrival_seq", F.unix_seconds("ts").alias("ts_s"), "src", "dst", "client", "server", "svc_port", "app", "bytes", "wire", "pkts", "flows", "exporter", "dup"),
    f"""WITH {_REC}, {_NORMAL}, {_SLICES}, c AS (SELECT *, {_CLIENT} AS c FROM part), v AS (SELECT *, CASE WHEN proto IN (6, 17, 132) THEN CASE WHEN c THEN dst_port ELSE src_port END ELSE 0 END AS svc FROM c)
    SELECT arrival_seq, m // 1000000 AS ts_s, src, dst, CASE WHEN c THEN src ELSE dst END AS client, CASE WHEN c THEN dst ELSE src END AS server, svc AS svc_port, {_APP} AS app, {_SHARES}, exporter,
      first_value({_POINT}) OVER (PARTITION BY m, src, dst, src_port, dst_port, proto ORDER BY arrival_seq) <> {_POINT} AS dup FROM v""",
)
_OBSERVED = "CASE WHEN observation <> 0 THEN observation WHEN direction = 0 THEN in_if WHEN direction = 1 THEN out_if ELSE 0 END"
register("ingest_observed", lambda s, d: queries_flow._epoch(rollups.observed(ingest.flow_rows(records(s, d), NOW))), f"""WITH {_REC}, {_NORMAL}, {_SLICES}, o AS (SELECT m, exporter, {_OBSERVED} AS o, {_SHARES} FROM part)
    SELECT m // 3600000000 * 3600 AS ts_s, CASE WHEN o <> 0 THEN 'obsif' ELSE 'obsunk' END AS dim, CASE WHEN o <> 0 THEN concat(exporter, '/', o) ELSE exporter END AS val, {queries_flow._SUMS} FROM o GROUP BY 1, 2, 3""")  # fmt: skip
_DELAY = "CASE " + " ".join(f"WHEN e_us - s_us <= {x} * 1000000 THEN {x}" for x in ingest.DELAYS) + " ELSE 999 END"
register("ingest_settle", lambda s, d: ingest.settle_seconds(records(s, d).withColumn("arrived", F.col("end"))), f"""WITH {_REC}, h AS (SELECT {_DELAY} AS d, sum(greatest(bytes * greatest(mult, 1), 1)) AS w FROM rec GROUP BY 1),
    c AS (SELECT d, sum(w) OVER (ORDER BY d) AS upto, sum(w) OVER () AS every FROM h) SELECT CAST(coalesce(min(d) FILTER (upto >= {ingest.ARRIVED} * every AND d < 999), {ingest.MOST_SETTLE}) + 1 AS INT) AS seconds FROM c""")  # fmt: skip


# -- the store: flow rows and summaries appended, hours sealed, a device's rows deleted, summaries rebuilt
def _stored(spark: SparkSession, folder: str, *summaries: str) -> store.Store:
    s, flows = store.Store(spark, new_path(spark, "store")), clean_flows(spark.read.parquet(f"{folder}/hot.parquet"))
    s.append("hot", flows)
    for name in summaries:
        s.append(name, rollups.ALL[name](flows))
    s.seal(NOW)
    return s


def _seal(spark: SparkSession, folder: str) -> DataFrame:
    s = _stored(spark, folder)
    assert not s.exists("hot")
    return s.read("flows").groupBy((F.unix_seconds("ts") - F.pmod(F.unix_seconds("ts"), F.lit(3600))).alias("ts_s")).agg(F.count("*").alias("rows"), F.sum("wire").alias("wire"))


def _purged(spark: SparkSession, folder: str) -> store.Store:
    s = _stored(spark, folder, "r_ts", "r_host", "r_dim")
    s.purge_exporter("10.66.0.1")
    return s


def _rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    s = _stored(spark, folder)
    s.append("r_host", rollups.r_host(s.read("flows").where("proto = 6")))  # not what the flows say
    s.rebuild(datetime(2026, 3, 1), datetime(2026, 4, 1))
    return s.read("r_host").drop("date")


_epoch = queries_flow._epoch
register("store_seal", _seal, f"WITH {queries_flow._FLOWS} SELECT epoch_us(ts) // 3600000000 * 3600 AS ts_s, count(*) AS rows, CAST(sum(wire) AS BIGINT) AS wire FROM flows GROUP BY 1")
register("store_views", lambda s, d: _epoch(_stored(s, d).read("r_ts_if").drop("date")), queries_flow.SQL["view_ts_if"])
register("store_rebuild", lambda s, d: _epoch(_rebuilt(s, d)), queries_flow.SQL["rollup_host"])
register("store_purge_exporter", lambda s, d: _purged(s, d).flows().groupBy("exporter").agg(F.count("*").alias("rows"), F.sum(F.col("dup").cast("long")).alias("dups")), SQL["promote_dup"])
register("store_purge_summaries", lambda s, d: _epoch(_purged(s, d).read("r_ts").drop("date")), SQL["promote_dup"].replace("SELECT exporter, count(*) AS rows, CAST(sum((dup AND (has OR n > 1))::INT) AS BIGINT) AS dups FROM g GROUP BY 1", f"SELECT epoch_us(ts) // 1000000 AS ts_s, app, {queries_flow._SUMS} FROM g WHERE NOT (dup AND (has OR n > 1)) GROUP BY 1, 2").replace("SELECT exporter, dup, bool_or", "SELECT ts, app, bytes, wire, pkts, flows, dup, bool_or").replace("coalesce(dup, false) AS dup", queries_flow._BLANKS))
register("store_exporters", lambda s, d: _stored(s, d).exporters().select("exporter", "wire", "rows", F.unix_seconds("first").alias("first_s"), F.unix_seconds("last").alias("last_s")), f"WITH {queries_flow._FLOWS} SELECT exporter, CAST(sum(wire) AS BIGINT) AS wire, count(*) AS rows, min(epoch_us(ts)) // 1000000 AS first_s, max(epoch_us(ts)) // 1000000 AS last_s FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
_PURGED = datetime(2026, 3, 10, 0, 40)


def _purged_before(spark: SparkSession, folder: str) -> DataFrame:
    s = _stored(spark, folder, "r_ts")
    s.purge(_PURGED)
    return s.read("flows").groupBy(F.lit("flows").alias("table")).agg(F.count("*").alias("rows"), F.sum("wire").alias("wire")).unionByName(s.read("r_ts").groupBy(F.lit("r_ts").alias("table")).agg(F.count("*").alias("rows"), F.sum("wire").alias("wire")))


_KEPT_SQL = "epoch_us(ts) >= 1773103200000000"
register("store_purge", _purged_before, f"""WITH {queries_flow._FLOWS} SELECT 'flows' AS "table", count(*) AS rows, CAST(sum(wire) AS BIGINT) AS wire FROM flows WHERE {_KEPT_SQL} UNION ALL SELECT 'r_ts', count(DISTINCT (ts, app)), CAST(sum(wire) AS BIGINT) FROM flows WHERE NOT dup AND {_KEPT_SQL}""")


def _retained(spark: SparkSession, folder: str) -> DataFrame:
    """A month after the first day, its detail goes and its summaries stay."""
    s = _stored(spark, folder, "r_ts")
    s.retain(datetime(2026, 4, 10, 1), detail=30, summary=60)
    flows = [s.read("flows")] if s.exists("flows") else [s.read("r_ts").where("false").select("ts", "wire")]
    count = lambda df, n: df.agg(F.lit(n).alias("table"), F.count("*").alias("rows"), F.coalesce(F.sum("wire"), F.lit(0)).alias("wire"))
    return count(flows[0], "flows").unionByName(count(s.read("r_ts"), "r_ts"))


register("store_retain", _retained, f"""WITH {queries_flow._FLOWS} SELECT 'flows' AS "table", count(*) AS rows, CAST(coalesce(sum(wire), 0) AS BIGINT) AS wire FROM flows WHERE epoch_us(ts) >= 1773187200000000 UNION ALL SELECT 'r_ts', count(DISTINCT (ts, app)), CAST(sum(wire) AS BIGINT) FROM flows WHERE NOT dup""")
register("store_repaired", lambda s, d: store.repaired(clean_flows(s.read.parquet(f"{d}/hot.parquet")).withColumn("bytes", F.when(F.col("sport") % 11 == 0, F.lit(-1).cast("long").bitwiseXOR(F.lit(-(2**63)))).otherwise(F.col("bytes")))).groupBy("exporter").agg(F.sum("bytes").alias("bytes"), F.sum("wire").alias("wire")), f"WITH {queries_flow._FLOWS} SELECT exporter, CAST(sum(CASE WHEN sport % 11 = 0 THEN 0 ELSE bytes END) AS BIGINT) AS bytes, CAST(sum(wire) AS BIGINT) AS wire FROM flows GROUP BY 1")


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "csv")
    store.counters_csv(interfaces.interface_hours(Tables(None, ifc=spark.read.parquet(f"{folder}/ifc.parquet")), queries_flow.POLLED), path)
    read = spark.read.schema("start string, exporter string, ifindex long, in_oct long, out_oct long, in_pkts long, out_pkts long, in_bps long, out_bps long").option("header", "true").csv(path)
    return read.select(F.unix_seconds(F.to_timestamp("start")).alias("start"), *read.columns[1:7])


register("export_csv", _csv, queries_flow.SQL["iface_hours"])
