"""Registered queries of the general data-processing operators, with SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.core.shared import new_path
from netloom.operators import grid, late, rolling, spikes


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return grid.empty_periods(table(spark, folder, "ifc"))


def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid.counter_grid(table(spark, folder, "ifc"))


def _corrected(spark: SparkSession, folder: str) -> DataFrame:
    return late.replay(table(spark, folder, "hot"), late.LateTotals(spark, new_path(spark, "late"))).read()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return late.disagreements(_corrected(spark, folder), table(spark, folder, "r_ts")).select("ts_s", "app")


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    out = _corrected(spark, folder)
    return out.selectExpr("minute_us div 1000000 as ts_s", "app", "bytes", "wire", "pkts", "flows", "records")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, folder, "ifc"))


def p5_outliers(spark: SparkSession, folder: str) -> DataFrame:
    rows = spikes.reading_checks(table(spark, folder, "ifc")).where("outlier")
    return rows.selectExpr("exporter", "ifindex", "us as ts_us", "rate", "expected", "residual")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.rising_hosts(table(spark, folder, "r_host"))


def p6_rolling(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.rolling_hosts(table(spark, folder, "r_host"))


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_totals, p5_found, p5_outliers, p6_found, p6_rolling)}

_ADDRESS = "CASE WHEN lower(trim({0}, chr(32)||chr(9)||chr(10)||chr(13))) LIKE '::ffff:%.%' THEN substr(lower(trim({0}, chr(32)||chr(9)||chr(10)||chr(13))), 8) ELSE lower(trim({0}, chr(32)||chr(9)||chr(10)||chr(13))) END"
_READINGS = f"""
readings AS (
  SELECT exporter, ifindex, us, arg_min(in_oct, (arrived_us, in_oct)) AS in_oct FROM (
    SELECT {_ADDRESS.format('exporter')} AS exporter, ifindex, epoch_us(ts) AS us, in_oct, epoch_us(arrived) AS arrived_us
    FROM ifc WHERE ts IS NOT NULL AND in_oct IS NOT NULL AND abs(epoch_us(ts) - epoch_us(arrived)) <= 172800000000)
  GROUP BY 1, 2, 3),
marked AS (
  SELECT *, coalesce(b <= a AND (in_oct < b OR in_oct > a), false) AS contradicted FROM (
    SELECT *, lag(in_oct) OVER w AS b, lead(in_oct) OVER w AS a FROM readings WINDOW w AS (PARTITION BY exporter, ifindex ORDER BY us))),
steps AS (
  SELECT exporter, ifindex, us, in_oct, lag(us) OVER w AS prev_us, lag(in_oct) OVER w AS prev_oct
  FROM marked WHERE NOT contradicted WINDOW w AS (PARTITION BY exporter, ifindex ORDER BY us)),
rates AS (
  SELECT *, CASE WHEN in_oct >= prev_oct AND us - prev_us < 3600000000 THEN 8.0::DOUBLE * (in_oct - prev_oct) / ((us - prev_us) / 1000000.0::DOUBLE) END AS rate FROM steps)"""
_HOSTS = f"""
hosts AS (
  SELECT * REPLACE ({_ADDRESS.format('ip')} AS ip, coalesce(bytes, 0) AS bytes) FROM (
    SELECT *, row_number() OVER (PARTITION BY arrival_seq ORDER BY arrived) AS rn FROM r_host) WHERE rn = 1)"""
_LATE = """
on_time AS (
  SELECT ts, app, bytes, wire, pkts, flows FROM (SELECT *, row_number() OVER (PARTITION BY arrival_seq ORDER BY arrived) AS rn FROM hot)
  WHERE rn = 1 AND NOT dup AND epoch_us(arrived) - epoch_us(ts) <= 7200000000 AND epoch_us(ts) - epoch_us(arrived) <= 120000000),
totals AS (
  SELECT epoch_us(ts) // 60000000 * 60 AS ts_s, app, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS bytes, CAST(sum(coalesce(wire, 0)) AS BIGINT) AS wire,
    CAST(sum(coalesce(pkts, 0)) AS BIGINT) AS pkts, CAST(sum(coalesce(flows, 0)) AS BIGINT) AS flows, count(*) AS records
  FROM on_time GROUP BY 1, 2)"""

SQL = {
    "p1_found": f"""WITH {_READINGS}
        SELECT s.exporter, s.ifindex, s.slot * 300 AS slot_s
        FROM (SELECT exporter, ifindex, unnest(range(min(us) // 300000000, max(us) // 300000000)) AS slot FROM readings GROUP BY 1, 2) s
        ANTI JOIN (SELECT DISTINCT exporter, ifindex, us // 300000000 AS slot FROM readings) r USING (exporter, ifindex, slot)""",
    "p2_found": f"""WITH {_LATE},
        stored AS (SELECT epoch_us(ts) // 60000000 * 60 AS ts_s, app, sum(wire) AS stored
          FROM (SELECT *, row_number() OVER (PARTITION BY arrival_seq ORDER BY arrived) AS rn FROM r_ts) WHERE rn = 1 GROUP BY 1, 2)
        SELECT coalesce(t.ts_s, s.ts_s) AS ts_s, coalesce(t.app, s.app) AS app FROM totals t FULL JOIN stored s ON t.ts_s = s.ts_s AND t.app = s.app
        WHERE coalesce(wire, 0) <> coalesce(stored, 0)""",
    "p2_totals": f"WITH {_LATE} SELECT * FROM totals",
    "p5_found": f"""WITH {_READINGS},
        speeds AS (SELECT {_ADDRESS.format('exporter')} AS exporter, ifindex, max(speed) AS speed FROM ifc WHERE speed > 0 AND speed <> 4294967295 GROUP BY 1, 2),
        medians AS (SELECT exporter, ifindex, median(rate) AS median FROM rates WHERE rate > 0 GROUP BY 1, 2),
        runs AS (SELECT *, coalesce(in_oct = prev_oct, false) AS again,
          sum(CASE WHEN in_oct = prev_oct THEN 0 ELSE 1 END) OVER (PARTITION BY exporter, ifindex ORDER BY us) AS run FROM rates),
        sized AS (SELECT *, count(*) OVER (PARTITION BY exporter, ifindex, run) AS size,
          sum(again::INT) OVER (PARTITION BY exporter, ifindex) * 5 < count(*) OVER (PARTITION BY exporter, ifindex) AS lively FROM runs)
        SELECT exporter, ifindex, us AS ts_us FROM marked WHERE contradicted
        UNION SELECT exporter, ifindex, us FROM rates JOIN speeds USING (exporter, ifindex) WHERE rate > speed
        UNION SELECT exporter, ifindex, us FROM rates JOIN medians USING (exporter, ifindex) WHERE rate >= 15 * median
        UNION SELECT exporter, ifindex, us FROM sized WHERE again AND size >= 6 AND lively""",
    "p5_outliers": f"""WITH {_READINGS},
        hourly AS (SELECT exporter, ifindex, us // 3600000000 AS slot, quantile_disc(rate, 0.5) AS t FROM rates WHERE rate IS NOT NULL GROUP BY 1, 2, 3),
        mid AS (SELECT exporter, ifindex, quantile_disc(t, 0.5) AS middle FROM hourly GROUP BY 1, 2),
        sea AS (SELECT exporter, ifindex, slot % 24 AS hour, quantile_disc(t, 0.5) AS season FROM hourly GROUP BY 1, 2, 3),
        tre AS (SELECT exporter, ifindex, slot // 24 AS day, quantile_disc(t - (season - middle), 0.5) AS trend
          FROM (SELECT *, slot % 24 AS hour FROM hourly) JOIN mid USING (exporter, ifindex) JOIN sea USING (exporter, ifindex, hour) GROUP BY 1, 2, 3),
        res AS (SELECT exporter, ifindex, us, rate, trend + season - middle AS expected, rate - (trend + season - middle) AS residual
          FROM (SELECT *, us // 3600000000 % 24 AS hour, us // 86400000000 AS day FROM rates WHERE rate IS NOT NULL) JOIN mid USING (exporter, ifindex) JOIN sea USING (exporter, ifindex, hour) JOIN tre USING (exporter, ifindex, day)),
        binned AS (SELECT *, CASE WHEN residual = 0 THEN -1000000 ELSE floor(ln(abs(residual)) / 0.05::DOUBLE) END AS b FROM res),
        cum AS (SELECT exporter, ifindex, b, CASE WHEN b = -1000000 THEN 0 ELSE exp((b + 0.5) * 0.05::DOUBLE) END AS size,
          sum(count(*)) OVER (PARTITION BY exporter, ifindex ORDER BY b) AS l, sum(count(*)) OVER (PARTITION BY exporter, ifindex) AS n FROM binned GROUP BY 1, 2, 3),
        scaled AS (SELECT c.exporter, c.ifindex, c.b, c.size, c.n::DOUBLE AS n, (c.n - c.l + 1)::DOUBLE AS i, 1.4826::DOUBLE * min(m.size) AS scale
          FROM cum c JOIN cum m ON c.exporter = m.exporter AND c.ifindex = m.ifindex AND m.l >= (c.l + 1) // 2 GROUP BY ALL),
        quant AS (SELECT *, n - i - 1 AS df, sqrt(-2 * ln(0.05::DOUBLE / (2 * (n - i + 1)))) AS u FROM scaled WHERE n - i >= 2 AND 2 * i <= n AND size > 0),
        normal AS (SELECT *, u - (2.515517::DOUBLE + 0.802853::DOUBLE * u + 0.010328::DOUBLE * u * u) / (1 + 1.432788::DOUBLE * u + 0.189269::DOUBLE * u * u + 0.001308::DOUBLE * u * u * u) AS z FROM quant),
        student AS (SELECT *, z + (z ** 3 + z) / (4 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * df ** 2) AS t FROM normal),
        beyond AS (SELECT exporter, ifindex, min(b) AS rest_from FROM student WHERE scale = 0 OR size / scale > (n - i) * t / sqrt((df + t * t) * (n - i + 1)) GROUP BY 1, 2)
        SELECT exporter, ifindex, us AS ts_us, rate, expected, residual FROM binned JOIN beyond USING (exporter, ifindex) WHERE b >= rest_from""",
    "p1_grid": f"""WITH {_READINGS},
        pairs AS (SELECT exporter, ifindex, us, prev_us, CASE WHEN in_oct >= prev_oct AND us - prev_us < 3600000000 THEN in_oct - prev_oct END AS rise FROM steps WHERE prev_us IS NOT NULL),
        cells AS (SELECT *, unnest(range(prev_us // 300000000, us // 300000000 + 1)) AS slot FROM pairs),
        cut AS (SELECT *, greatest(prev_us, slot * 300000000) AS a, least(us, (slot + 1) * 300000000) AS z FROM cells),
        shares AS (SELECT exporter, ifindex, slot, CASE WHEN rise IS NOT NULL THEN z - a ELSE 0 END AS covered,
          CAST(round(rise * ((z - prev_us)::DOUBLE / (us - prev_us))) AS BIGINT) - CAST(round(rise * ((a - prev_us)::DOUBLE / (us - prev_us))) AS BIGINT) AS octets FROM cut),
        known AS (SELECT exporter, ifindex, slot, sum(octets) AS octets, sum(covered) AS covered_us FROM shares GROUP BY 1, 2, 3),
        seen AS (SELECT exporter, ifindex, us // 300000000 AS slot, count(*) AS readings FROM readings GROUP BY 1, 2, 3)
        SELECT exporter, ifindex, slot * 300 AS slot_s, coalesce(readings, 0) AS readings, CASE WHEN covered_us > 0 THEN CAST(octets AS BIGINT) END AS octets, CAST(coalesce(covered_us, 0) AS BIGINT) AS covered_us,
          CASE WHEN coalesce(covered_us, 0) = 0 THEN 'missing' WHEN covered_us < 300000000 THEN 'partial' WHEN readings > 0 THEN 'measured' ELSE 'filled' END AS state
        FROM known FULL JOIN seen USING (exporter, ifindex, slot)""",
    "p6_found": f"""WITH {_HOSTS},
        bounds AS (SELECT min(epoch_us(ts)) // 86400000000 AS f, max(epoch_us(ts)) // 86400000000 AS l FROM r_host),
        per AS (SELECT ip, epoch_us(ts) // 86400000000 AS day, sum(bytes) AS bytes FROM hosts WHERE internal AND ts IS NOT NULL AND ip IS NOT NULL AND ip <> '' GROUP BY 1, 2),
        days AS (SELECT ip, unnest(range(f, l + 1)) AS day FROM (SELECT DISTINCT ip FROM per), bounds),
        dense AS (SELECT d.ip, d.day, coalesce(bytes, 0) AS bytes FROM days d LEFT JOIN per p ON d.ip = p.ip AND d.day = p.day),
        t AS (SELECT ip, day, sum(bytes) OVER (PARTITION BY ip ORDER BY day ROWS 6 PRECEDING) AS t7, sum(bytes) OVER (PARTITION BY ip ORDER BY day ROWS 29 PRECEDING) AS t30 FROM dense)
        SELECT ip, strftime(DATE '1970-01-01' + CAST(day AS INT), '%Y-%m-%d') AS day FROM t, bounds WHERE day >= f + 29 AND t7 > 0 AND t7 * 10 >= t30 * 7""",
    "p6_rolling": f"""WITH {_HOSTS},
        bounds AS (SELECT min(epoch_us(ts)) // 86400000000 AS f, max(epoch_us(ts)) // 86400000000 AS l FROM r_host),
        per AS (SELECT ip, epoch_us(ts) // 86400000000 AS day, sum(bytes) AS bytes FROM hosts WHERE ts IS NOT NULL AND ip IS NOT NULL AND ip <> '' GROUP BY 1, 2),
        days AS (SELECT ip, unnest(range(f, l + 1)) AS day FROM (SELECT DISTINCT ip FROM per), bounds),
        dense AS (SELECT d.ip, d.day, coalesce(bytes, 0) AS bytes FROM days d LEFT JOIN per p ON d.ip = p.ip AND d.day = p.day),
        t AS (SELECT ip, day, CAST(bytes AS BIGINT) AS bytes, CAST(sum(bytes) OVER (PARTITION BY ip ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS total7,
          CAST(sum(bytes) OVER (PARTITION BY ip ORDER BY day ROWS 29 PRECEDING) AS BIGINT) AS total30 FROM dense)
        SELECT ip, day, bytes, total7, total7 / 7 AS avg7, total30, total30 / 30 AS avg30 FROM t""",
}
