"""Source health, waiting stages, smoothed rates and metrics text."""

from datetime import datetime, timedelta, timezone

from netloom.operators import health

NOW = datetime(2026, 3, 10, 12, 0, tzinfo=timezone.utc)


def test_codes(spark):
    schema = "exporter string, last_seen timestamp, pending long, assumed boolean, received long, lost long, drops long, no_template long, skew_s double, errors long"
    rows = [("fine", NOW, 0, False, 1000, 5, 0, 0, 1.0, 0), ("never", None, None, None, None, None, None, None, None, None), ("all", NOW - timedelta(hours=1), 1, True, 100, 50, 1, 1, -500.0, 1)]
    got = {r.exporter: r.codes for r in health.source_health(spark.createDataFrame(rows, schema), NOW).collect()}
    assert got == {"fine": [], "never": ["silent"], "all": list(health.CODES)}


def test_waiting():
    args = lambda **k: dict(datagrams=1, templates=True, records=1, pending=0, rows=1, first_data=NOW - timedelta(hours=1), now=NOW) | k
    assert health.waiting_for(**args()) == "" and health.waiting_for(**args(datagrams=0)) == "nothing"
    assert health.waiting_for(**args(templates=False, records=0)) == "templates" and health.waiting_for(**args(pending=5, rows=0)) == "sampling"
    assert health.waiting_for(**args(first_data=NOW)) == "settling"


def test_rates_and_metrics(spark):
    rows = [("e", 0, 0), ("e", 10, 100), ("e", 20, 300), ("e", 30, 0)]
    got = [r.rate for r in health.rates(spark.createDataFrame(rows, "exporter string, at long, records long")).orderBy("at").collect()]
    assert got[:2] == [10.0, 10 * 0.4 + 20 * 0.6] and abs(got[2] - 16 * 0.4) < 1e-9
    lines = health.metrics_text(spark.createDataFrame([("a_total", {"x": 'q"'}, 5.0), ("b", None, 0.5)], "name string, labels map<string,string>, value double")).collect()
    assert [r.line for r in lines] == ['a_total{x="q\\""} 5', "b 0.5"]
