"""Frequent items, distinct counts and percentiles against plain Python."""

from collections import Counter
from datetime import datetime, timedelta, timezone
from random import Random
from statistics import median

from pyspark.sql import functions as F

from netloom.llm import distinct, heavy, percentiles

T0 = datetime(2026, 3, 2, tzinfo=timezone.utc)


def test_frequent_items(spark):
    rng = Random(3)
    rows = [(rng.choice(["a", "a", "b", f"x{rng.randint(0, 3000)}", None]), rng.choice([None, 1, 5, 100])) for _ in range(9000)]
    rows += [(f"big{i}", 40_000) for i in range(3)]
    df = spark.createDataFrame(rows, "item string, bytes long").repartition(7)
    n, b = Counter(), Counter()
    for item, size in rows:
        if item is not None:
            n[item] += 1
            b[item] += size or 0
    for most in (1_000_000, 50):  # with so few items in memory a task is many nodes
        got = {(r.measure, r.item): r.amount for r in heavy.frequent_items(df, one_in=100, most=most).collect()}
        assert got == {("rows", k): v for k, v in n.items() if v * 100 >= sum(n.values())} | {("bytes", k): v for k, v in b.items() if v * 100 >= sum(b.values())}
        top = [(r.item, r.amount) for r in heavy.frequent_items(df, k=20, most=most).where("measure = 'rows'").collect()]
        assert sorted(top) == sorted(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:20])
    assert heavy.frequent_items(df.limit(0), one_in=100).count() == 0
    assert heavy.frequent_items(df.limit(0), k=3).count() == 0
    assert {r.measure for r in heavy.frequent_items(spark.createDataFrame([("z", None)], "item string, bytes long"), one_in=100).collect()} == {"rows"}


def test_bitmaps_estimate_and_merge(spark):
    sizes = {"none": 1, "small": 50, "mid": 5_000, "large": 60_000, "huge": 700_000}
    for name, n in sizes.items():
        ids = spark.range(n).select(F.lit(name).alias("g"), (F.col("id") % 2).alias("half"), F.concat(F.lit(name), F.col("id")).alias("v"))
        ids = ids.unionByName(ids.where("half = 0"))
        parts = distinct.sketch(ids, ["g", "half"], "v")
        (got,) = distinct.estimates(distinct.merged(parts, ["g"]), ["g"]).collect()
        (direct,) = distinct.estimates(distinct.sketch(ids, ["g"], "v"), ["g"]).collect()
        assert got.estimate == direct.estimate and abs(got.estimate / n - 1) <= 3 * got.error
    assert distinct.estimates(distinct.sketch(ids.where("v is null"), ["g"], "v"), ["g"]).count() == 0


def test_busy_days_against_sets(spark):
    rng, hosts, dims, sets = Random(5), [], [], {}
    for day in range(12):
        for _ in range(900 if day == 4 else 300):
            ip, role, inner = f"10.{rng.randint(0, 9)}.0.{rng.randint(0, 99)}", rng.choice([1, 2]), rng.choice([True, False, None])
            hosts.append((T0 + timedelta(days=day), rng.choice(["", " ", "::FFFF:"]) + ip, role, inner, "x"))
            for g in [f"role={role}"] + ([f"role={role},internal={str(inner).lower()}"] if inner is not None else []):
                sets.setdefault(g, {}).setdefault(day, set()).add(ip)
        for _ in range(20):
            v = f"k{rng.randint(0, 3 if day != 6 else 30)}"
            dims.append((T0 + timedelta(days=day), "port", f"{v}\t{rng.random()}", 1))
            sets.setdefault("dim=port", {}).setdefault(day, set()).add(v)
    hosts += [(None, "10.0.0.1", 1, True, "x"), (T0, None, 1, True, "x"), (T0, " ", 1, True, "x")]
    dims += [(None, "port", "zz", 1), (T0, "port", None, 1)]
    h = spark.createDataFrame(hosts, "ts timestamp, ip string, role short, internal boolean, grp string")
    d = spark.createDataFrame(dims, "ts timestamp, dim string, val string, day int")
    want = {((T0 + timedelta(days=x)).strftime("%Y-%m-%d"), g) for g, per in sets.items() for x, s in per.items() if len(s) >= 1.5 * median(map(len, per.values()))}
    assert {tuple(r) for r in distinct.busy_days(h, d).collect()} == want and len(want) >= 4
    for r in distinct.daily_counts(h, d).collect():
        n = len(sets[r.grp][(datetime.strptime(r.day, "%Y-%m-%d").replace(tzinfo=timezone.utc) - T0).days])
        assert abs(r.estimate - n) <= max(1, 0.03 * n)
    assert distinct.busy_days(h.limit(0), d.limit(0)).count() == 0


def test_percentiles_are_nearest_rank_and_merge(spark):
    rng = Random(6)
    data = {g: [rng.choice([1.0, 1.0, rng.uniform(-9, 9), float(rng.randint(0, 5))]) for _ in range(n)] for g, n in (("a", 1), ("b", 20), ("c", 21), ("d", 5000))}
    df = spark.createDataFrame([(g, v, i % 3) for g, vs in data.items() for i, v in enumerate(vs)] + [("e", None, 0), ("a", float("nan"), 1)], "g string, v double, day int")
    daily = percentiles.value_counts(df, ["g", "day"], "v")
    got = {(r.g, r.point): (r.n, r.value) for r in percentiles.percentiles(percentiles.merged_counts(daily, ["g"]), ["g"]).collect()}
    assert got == {(g, p): (len(v), sorted(v)[-(-len(v) * p // 1000) - 1]) for g, v in data.items() for p in percentiles.POINTS}
    assert percentiles.percentiles(daily.limit(0), ["g"]).count() == 0


def test_misstated(spark):
    rows = [(T0 + timedelta(minutes=5 * k), "10.0.0.1", 1, 10**9, 1000 * k * (k + 1) // 2, T0 + timedelta(minutes=5 * k)) for k in range(400)]
    ifc = spark.createDataFrame(rows, "ts timestamp, exporter string, ifindex long, speed long, in_oct long, arrived timestamp")
    rates = sorted(8 * 1000 * k / 300 for k in range(1, 288))
    true = rates[-(-len(rates) * 95 // 100) - 1]
    day = T0 + timedelta(days=1)
    rep = [("::ffff:10.0.0.1", 1, T0, day, true * 1.09), ("10.0.0.1", 1, T0, day, true * 1.11), ("10.0.0.1 ", 1, T0, day, true * 1.11), ("10.0.0.1", 1, T0, day, None), ("10.0.0.1", 2, T0, day, 5.0), ("10.0.0.1", 1, None, day, 5.0), ("10.0.0.1", 1, day, T0, 5.0)]
    report = spark.createDataFrame(rep, "exporter string, ifindex long, period_from timestamp, period_to timestamp, in95 double")
    assert [tuple(r) for r in percentiles.misstated_p95(ifc, report).collect()] == [("10.0.0.1", 1, int(T0.timestamp()), int(day.timestamp()))]
    assert percentiles.misstated_p95(ifc.limit(0), report.limit(0)).count() == 0
