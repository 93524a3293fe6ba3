"""Registered queries of this subpackage, with SQL that states the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.core.shared import cut
from netloom.llm import distinct, heavy, leak, packing, percentiles, splitting
from netloom.queries_data import _ADDRESS, _HOSTS, _READINGS, table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = heavy.frequent_items(heavy.host_items(table(spark, folder, "r_host")), one_in=100)
    return found.selectExpr("measure", "item as ip")


def p3_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = heavy.frequent_items(heavy.host_items(table(spark, folder, "r_host")), k=100)
    return found.selectExpr("measure", "item as ip", "amount")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return distinct.busy_days(table(spark, folder, "r_host"), table(spark, folder, "r_dim"))


def p4_daily(spark: SparkSession, folder: str) -> DataFrame:
    return distinct.daily_counts(table(spark, folder, "r_host"), table(spark, folder, "r_dim"))


def p4_weekly(spark: SparkSession, folder: str) -> DataFrame:
    return distinct.weekly_counts(table(spark, folder, "r_host"), table(spark, folder, "r_dim"))


def p4_daily_bound(spark: SparkSession, folder: str) -> DataFrame:
    return distinct.within_error(table(spark, folder, "r_host"), table(spark, folder, "r_dim"))


def p4_weekly_bound(spark: SparkSession, folder: str) -> DataFrame:
    return distinct.within_error(table(spark, folder, "r_host"), table(spark, folder, "r_dim"), True)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.misstated_p95(table(spark, folder, "ifc"), table(spark, folder, "report_iface"))


def p7_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.report_percentiles(table(spark, folder, "ifc"), table(spark, folder, "report_iface"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(table(spark, folder, "documents"), 2_048)


def p8_containers_8192(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(table(spark, folder, "documents"), 8_192)


def _containers_checked(spark: SparkSession, folder: str, capacity: int) -> DataFrame:
    """What an assignment must hold, as one row: every document once and whole, no container too full, none needlessly
    divided, and how many containers there are beside the fewest possible."""
    placed = cut(packing.containers(table(spark, folder, "documents"), capacity), "placed")
    per = placed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.max(F.col("from_token") + F.col("tokens")).alias("to"), F.count_distinct("piece").alias("different"))
    full = placed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    docs = per.agg(
        F.count("*").alias("documents"), F.count(F.when((F.col("to") != F.col("tokens")) | (F.col("different") != F.col("pieces")), 1)).alias("broken"),
        F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= capacity), 1)).alias("divided"), F.sum("tokens").alias("tokens"),
    )
    fewest = F.ceil(F.col("tokens") / capacity)
    bins = full.agg(F.count(F.when(F.col("tokens") > capacity, 1)).alias("over_full"), F.count("*").alias("containers"))
    row = docs.withColumn("one", F.lit(1)).join(bins.withColumn("one", F.lit(1)), "one")  # one row each
    return row.select("documents", "broken", "divided", "over_full", (F.col("containers") <= fewest * 1.01 + 1).alias("within_1_percent"))


def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    return _containers_checked(spark, folder, 2_048)


def p8_checked_8192(spark: SparkSession, folder: str) -> DataFrame:
    return _containers_checked(spark, folder, 8_192)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leak.shared_words(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_altered(spark: SparkSession, folder: str) -> DataFrame:
    return leak.altered_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_documents(table(spark, folder, "documents"))


def p10_checked(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, gaps, too_large, rebuilt: of each document with text whether its pieces follow one another, keep the limit, and
    give its text back when what they repeat is left out."""
    cut_up = splitting.split_documents(table(spark, folder, "documents"), whole=True)
    own = F.expr("substr(text, CAST(own_char - from_char + 1 AS INT))")
    per = cut_up.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("piece", "own_char", "to_char", own.alias("own")))).alias("ps"), F.count(F.when(F.col("tokens") > 512, 1)).alias("too_large"),
    )
    gaps = F.size(F.filter(F.arrays_zip(F.slice("ps.own_char", 2, 1 << 30).alias("a"), F.slice("ps.to_char", 1, 1 << 30).alias("b")), lambda x: x["a"] != x["b"]))
    return per.select("doc_id", gaps.cast("long").alias("gaps"), "too_large", F.length(F.array_join("ps.own", "")).cast("long").alias("chars"), F.md5(F.array_join("ps.own", "")).alias("rebuilt"))


QUERIES = {f.__name__: f for f in (p3_found, p3_topk, p4_found, p4_daily, p4_weekly, p4_daily_bound, p4_weekly_bound, p7_found, p7_percentiles, p8_containers, p8_containers_8192, p8_checked, p8_checked_8192, p9_found, p9_altered, p10_pieces, p10_checked)}

_PERIODS = f"""
periods AS (SELECT DISTINCT {_ADDRESS.format('exporter')} AS exporter, ifindex, epoch_us(period_from) AS f, epoch_us(period_to) AS t FROM report_iface),
ranked AS (SELECT p.exporter, p.ifindex, f, t, rate, row_number() OVER w AS r, count(*) OVER (PARTITION BY p.exporter, p.ifindex, f, t) AS n
  FROM periods p JOIN rates r ON p.exporter = r.exporter AND p.ifindex = r.ifindex AND us >= f AND us < t WHERE rate IS NOT NULL
  WINDOW w AS (PARTITION BY p.exporter, p.ifindex, f, t ORDER BY rate)),
points AS (SELECT exporter, ifindex, f, t, n, max(rate) FILTER (r = (n * 500 + 999) // 1000) AS p50, max(rate) FILTER (r = (n * 900 + 999) // 1000) AS p90,
  max(rate) FILTER (r = (n * 950 + 999) // 1000) AS p95, max(rate) FILTER (r = (n * 990 + 999) // 1000) AS p99 FROM ranked GROUP BY ALL)"""

_IDS = f"""ids AS (
    SELECT epoch_us(ts) // 86400000000 AS day, unnest(CASE WHEN internal IS NULL THEN ['role=' || role] ELSE ['role=' || role, 'role=' || role || ',internal=' || internal] END) AS grp, {_ADDRESS.format('ip')} AS id
    FROM r_host WHERE ts IS NOT NULL AND ip IS NOT NULL AND role IS NOT NULL
    UNION ALL SELECT epoch_us(ts) // 86400000000, 'dim=' || dim, split_part(val, chr(9), 1) FROM r_dim WHERE ts IS NOT NULL AND val IS NOT NULL AND dim IS NOT NULL)"""

SQL = {
    "p3_found": f"""WITH {_HOSTS}, per AS (SELECT ip, count(*) AS n, sum(bytes) AS b FROM hosts WHERE ip IS NOT NULL AND ip <> '' GROUP BY 1)
        SELECT 'rows' AS measure, ip FROM per WHERE n * 100 >= (SELECT sum(n) FROM per) UNION ALL SELECT 'bytes', ip FROM per WHERE b * 100 >= (SELECT sum(b) FROM per)""",
    "p3_topk": f"""WITH {_HOSTS}, per AS (SELECT ip, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS b FROM hosts WHERE ip IS NOT NULL AND ip <> '' GROUP BY 1)
        SELECT * FROM (SELECT 'rows' AS measure, ip, n AS amount FROM per ORDER BY n DESC, ip LIMIT 100) UNION ALL SELECT * FROM (SELECT 'bytes', ip, b FROM per ORDER BY b DESC, ip LIMIT 100)""",
    "p4_found": f"""WITH {_IDS},
        per AS (SELECT day, grp, count(DISTINCT id) AS n FROM ids GROUP BY 1, 2)
        SELECT strftime(DATE '1970-01-01' + CAST(day AS INT), '%Y-%m-%d') AS day, grp FROM per JOIN (SELECT grp, median(n) AS m FROM per GROUP BY 1) USING (grp) WHERE n >= 1.5 * m""",
    "p4_daily_bound": f"""WITH {_IDS} SELECT strftime(DATE '1970-01-01' + CAST(day AS INT), '%Y-%m-%d') AS day, grp, count(DISTINCT id) AS n, true AS ok FROM ids GROUP BY ALL""",
    "p4_weekly_bound": f"""WITH {_IDS} SELECT strftime(DATE '1970-01-01' + CAST(day - (day + 3) % 7 AS INT), '%Y-%m-%d') AS week, grp, count(DISTINCT id) AS n, true AS ok FROM ids GROUP BY ALL""",
    "p7_found": f"""WITH {_READINGS}, {_PERIODS}
        SELECT DISTINCT p.exporter, p.ifindex, f // 1000000 AS from_s, t // 1000000 AS to_s FROM points p
        JOIN report_iface r ON p.exporter = {_ADDRESS.format('r.exporter')} AND p.ifindex = r.ifindex AND f = epoch_us(period_from) AND t = epoch_us(period_to) WHERE abs(in95 - p95) > 0.1::DOUBLE * p95""",
    "p7_percentiles": f"WITH {_READINGS}, {_PERIODS} SELECT exporter, ifindex, f // 1000000 AS from_s, t // 1000000 AS to_s, n, p50, p90, p95, p99 FROM points",
    "p8_checked": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS over_full, true AS within_1_percent FROM documents",
    "p8_checked_8192": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS over_full, true AS within_1_percent FROM documents",
    "p10_checked": "SELECT doc_id, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS too_large, length(text) AS chars, md5(text) AS rebuilt FROM documents WHERE text IS NOT NULL AND text <> ''",
}
