"""Counter grid, late totals, spike checks and rolling totals on small inputs."""

from datetime import datetime, timedelta, timezone
from random import Random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.core.order_stats import bracket, bracketed_medians
from netloom.core.shared import new_path
from netloom.operators import grid, late, rolling, spikes

T0 = datetime(2026, 3, 2, tzinfo=timezone.utc)
IFC = "ts timestamp, exporter string, ifindex long, speed long, in_oct long, out_oct long, in_pkts long, out_pkts long, arrived timestamp, slot string, rate string"


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def ifc(spark, rows):
    """rows: (minutes, exporter, ifindex, speed, in_oct[, arrived minutes])."""
    full = [(None if r[0] is None else at(r[0]), r[1], r[2], r[3], r[4], 0, 0, 0, at(r[5] if len(r) > 5 else (r[0] or 0)), "x", "y") for r in rows]
    return spark.createDataFrame(full, IFC)


def test_grid_spreads_and_marks(spark):
    rows = [(0, "10.0.0.1", 1, None, 0), (10, " ::FFFF:10.0.0.1", 1, None, 600), (12, "10.0.0.1", 1, None, 700), (12, "10.0.0.1", 1, None, 700),
            (85, "10.0.0.1", 1, None, 900), (90, "10.0.0.1", 1, None, 100),
            (None, "10.0.0.1", 1, None, 5), (5, None, 1, None, 5), (5, "10.0.0.1", None, None, 5), (5, "10.0.0.1", 1, None, None), (5, "10.0.0.1", 1, None, 7, 5 + 49 * 60)]
    out = {(r.slot_s - int(T0.timestamp())) // 300: r for r in grid.counter_grid(ifc(spark, rows)).collect()}
    assert sorted(out) == list(range(19))
    assert [(out[i].readings, out[i].octets, out[i].state) for i in (0, 1, 2)] == [(1, 300, "measured"), (0, 300, "filled"), (2, 100, "partial")]
    assert all(out[i].state == "missing" and out[i].octets is None for i in range(3, 17))  # an hour's gap
    assert (out[17].readings, out[17].state, out[18].readings, out[18].octets) == (1, "missing", 1, None)  # a reset
    empty = {(r.slot_s - int(T0.timestamp())) // 300 for r in grid.empty_periods(ifc(spark, rows)).collect()}
    assert empty == {1, *range(3, 17)}


def test_grid_of_nothing(spark):
    assert grid.counter_grid(ifc(spark, [])).count() == 0
    assert grid.counter_grid(ifc(spark, [(None, None, None, None, None)])).count() == 0


def brute_checks(rows):
    """Findings of one interface by plain loops over (us, in_oct), sorted by us."""
    bad = {i for i in range(1, len(rows) - 1) if rows[i - 1][1] <= rows[i + 1][1] and not rows[i - 1][1] <= rows[i][1] <= rows[i + 1][1]}
    kept = [r for i, r in enumerate(rows) if i not in bad]
    rates = {}
    for (u, a), (v, b) in zip(kept, kept[1:]):
        if b >= a and v - u < 3_600_000_000:
            rates[v] = 8.0 * (b - a) / ((v - u) / 1e6)
    return {rows[i][0] for i in bad}, kept, rates


def test_spikes_against_loops(spark):
    rng, rows, want = Random(4), [], set()
    for interface in range(1, 6):
        total, minute, own = 10**6, 0.0, []
        while minute < 3 * 1440:
            minute += rng.choice([4, 5, 5, 6, 30, 90 if rng.random() < 0.05 else 5])
            total += int(rng.uniform(1, 3) * 10**5 * (30 if rng.random() < 0.01 else 1))
            own.append([minute, total])
        for k in range(20, len(own) - 20, 97):
            own[k][1] += rng.choice([-1, 1]) * 10**9
        for k in range(50, 58 + interface):
            own[k][1] = own[50][1]
        speed = 10**5 if interface == 3 else None
        rows += [(m, "10.0.0.1", interface, speed, v) for m, v in own]
        us = [(int(at(m).timestamp() * 1e6), v) for m, v in own]
        bad, kept, rates = brute_checks(us)
        usual = median(r for r in rates.values() if r > 0)
        found = bad | {u for u, r in rates.items() if r >= 15 * usual or (speed and r > speed)}
        repeats = sum(a[1] == b[1] for a, b in zip(kept, kept[1:]))
        run = [kept[0]]
        for r in [*kept[1:], (None, None)]:
            if r[1] == run[0][1]:
                run.append(r)
            else:
                if len(run) >= 6 and repeats * 5 < len(kept):
                    found |= {u for u, _ in run[1:]}
                run = [r]
        want |= {("10.0.0.1", interface, u) for u in found}
    rng.shuffle(rows)
    got = {tuple(r) for r in spikes.implausible_readings(ifc(spark, rows)).collect()}
    assert got == want and len(want) > 30


def test_extremes_are_those_of_the_test_that_removes_one_after_the_other():
    rng = np.random.default_rng(3)
    for n, far in ((3, 0), (10, 1), (40, 4), (300, 12), (300, 0)):
        sizes = np.sort(np.abs(np.concatenate([rng.normal(size=n - far), rng.normal(30, 5, far)])))
        last = 0
        for i in range(1, n // 2 + 1):  # the i-th most extreme, with the scale of what is left
            left = sizes[: n - i + 1]
            if left[-1] / (spikes.MAD_TO_SD * left[(len(left) + 1) // 2 - 1]) > spikes.esd_limits(n, np.array([float(i)]), 0.05)[0]:
                last = i
        got = spikes.extreme(sizes, np.ones(n, int), 0.05)
        assert got.sum() == last >= far and got[n - last :].all()
    # A removed point no longer widens the scale: five of seven far points don't hide each other.
    assert spikes.extreme(np.array([1.0, 1.1, 1.2, 50.0]), np.array([20, 20, 20, 20]), 0.05).tolist() == [False, False, False, True]


def test_planted_seasonal_outliers(spark):
    """A rate that is usual at noon is extreme at night, and the daily wave itself isn't."""
    rng, rows, total, planted = Random(6), [], 0, set()
    for k in range(10 * 288):
        noon = 11 * 12 <= k % 288 < 14 * 12
        amount = rng.randint(90, 110) * 1000 * (20 if noon else 1)
        if k in (700, 1380, 2200):
            amount, planted = 2_000_000, planted | {int(at(k * 5).timestamp() * 1e6)}
        total += amount
        rows.append((k * 5, "10.0.0.1", 1, None, total))
    found = {r.us for r in spikes.reading_checks(ifc(spark, rows)).where("outlier and residual > 20000").collect()}
    edges = lambda us: ((us // 10**6 - int(T0.timestamp())) // 300) % 288
    assert planted <= found and all(u in planted or 11 * 12 - 1 <= edges(u) <= 14 * 12 + 1 for u in found)


def test_outliers_leave_the_daily_wave_alone(spark):
    rows, total = [], 0
    for k in range(6 * 288):
        busy = 8 if 8 <= (k // 12) % 24 < 18 else 1
        total += busy * 10**6 + (k * 7919) % 50_000 + (40 * 10**6 if k == 900 else 0)
        rows.append((k * 5, "10.0.0.1", 1, None, total))
    flagged = spikes.reading_checks(ifc(spark, rows)).where("outlier").collect()
    assert int(at(4500).timestamp() * 1e6) in {r.us for r in flagged} and len(flagged) < 40


def test_stuck_across_chunks_and_empty(spark):
    rows = [(m, "10.0.0.1", 1, None, m * 1000) for m in range(0, 4000, 5)]
    rows = [(m, e, i, s, 340 * 1000 if 340 <= m <= 800 else v) for m, e, i, s, v in rows]  # over two chunk bounds
    got = {r.ts_us for r in spikes.implausible_readings(ifc(spark, rows)).collect()}
    assert {int(at(m).timestamp() * 1e6) for m in range(345, 801, 5)} <= got
    assert spikes.implausible_readings(ifc(spark, [])).count() == 0


def test_exact_medians(spark):
    rng = Random(1)
    data = {g: [rng.choice([rng.uniform(-5, 5), 0.0, 2.0, 1e12]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 999), ("d", 1000), ("f", 20_000))}
    data["g"] = [rng.random() for _ in range(20_001)]
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("e", None)], "g string, v double")
    rows = df.join(df.groupBy("g").agg(bracket(F.col("v")).alias("ends")), "g")
    assert {r.g: r.median for r in bracketed_medians(rows, ["g"], "v", "ends").collect()} == {g: median(v) for g, v in data.items()}


HOST = "ts timestamp, ip string, role short, internal boolean, bytes long, wire long, pkts long, flows long, arrival_seq long, arrived timestamp, day string"


def test_rolling_against_loops(spark):
    rng, rows, per = Random(2), [], {}
    for seq in range(400):
        ip, day = f"10.0.0.{rng.randint(1, 6)}", rng.randint(0, 39)
        b = rng.choice([None, rng.randint(1, 1000), rng.randint(1, 9)])
        rows.append((T0 + timedelta(days=day), rng.choice(["", " ", "::ffff:"]) + ip, 1, True, b, 0, 0, 0, seq, at(seq), "d"))
        per[ip, day] = per.get((ip, day), 0) + (b or 0)
    again = [(*r[:9], r[9] + timedelta(days=1), "d") for r in rows[:50]]
    junk = [(None, "10.0.0.1", 1, True, 5, 0, 0, 0, 900, at(0), "d"), (T0, None, 1, True, 5, 0, 0, 0, 901, at(0), "d"), (T0, "10.0.0.9", 1, None, 5, 0, 0, 0, None, None, "d")]
    df = spark.createDataFrame(rows + again + junk, HOST)
    days = {d for _, d in per} | {0}
    first, last = min(days), max(days)
    day0 = int(T0.timestamp()) // 86400
    total = lambda ip, d, n: sum(per.get((ip, x), 0) for x in range(d - n + 1, d + 1))
    got = {(r.ip, r.day - day0): (r.total7, r.total30) for r in rolling.rolling_hosts(df).where("ip <> '10.0.0.9'").collect()}
    assert got == {(ip, d): (total(ip, d, 7), total(ip, d, 30)) for ip in {i for i, _ in per} for d in range(first, last + 1)}
    rising = {(r.ip, r.day) for r in rolling.rising_hosts(df).collect()}
    assert rising == {(ip, (T0 + timedelta(days=d)).strftime("%Y-%m-%d")) for ip, d in got if d >= first + 29 and got[ip, d][0] > 0 and got[ip, d][0] / 7 >= 3 * got[ip, d][1] / 30}
    assert rolling.rising_hosts(df.limit(0)).count() == 0 and rolling.rolling_hosts(df.limit(0)).count() == 0


HOT = "ts timestamp, app string, bytes long, wire long, pkts long, flows long, dup boolean, arrival_seq long, arrived timestamp, period long, batch string"


def hot(spark, rows):
    return spark.createDataFrame([(None if t is None else at(t), app, 1, w, 1, 1, dup, seq, at(arr), 7, "b") for t, app, w, dup, seq, arr in rows], HOT)


def test_late_rows_correct_earlier_minutes(spark):
    first = [(0, "A", 10, False, 1, 1), (0, "A", 5, True, 2, 1), (60, "A", 7, False, 3, 61), (None, "A", 9, False, 4, 1), (99, "B", 1, False, 5, 61)]
    second = [(0, "A", 100, False, 6, 120), (0, "A", 1000, False, 7, 121), (0, "A", 10, False, 1, 90), (1, None, 3, False, 8, 100)]
    totals = late.LateTotals(spark, new_path(spark, "late"))
    assert len(totals.apply(hot(spark, first), 0)) == 2
    before = {(r.minute_us, r.app): r.wire for r in totals.read().collect()}
    minute = lambda m: int(at(m).timestamp() * 1e6)
    assert before == {(minute(0), "A"): 10, (minute(60), "A"): 7}
    totals.apply(hot(spark, second), 1)
    after = {(r.minute_us, r.app): r.wire for r in totals.read().collect()}
    assert after == {(minute(0), "A"): 110, (minute(60), "A"): 7, (minute(1), None): 3}
    totals.apply(hot(spark, second), 1)  # a batch that was committed before
    assert {(r.minute_us, r.app): r.wire for r in totals.read().collect()} == after
    totals.forget(0)
    assert {(r.minute_us, r.app): r.wire for r in totals.read().collect()} == after
    r_ts = spark.createDataFrame([(at(0), "A", 60, 1, at(1)), (at(0), "A", 50, 2, at(1)), (at(0), "A", 50, 2, at(2)), (at(60), "A", 8, 3, at(2)), (None, "A", 8, 4, at(2))], "ts timestamp, app string, wire long, arrival_seq long, arrived timestamp")
    off = {(r.ts_s, r.app) for r in late.disagreements(totals.read(), r_ts).collect()}
    assert off == {(minute(60) // 10**6, "A"), (minute(1) // 10**6, None)}


def test_a_dead_batch_leaves_no_trace(spark, monkeypatch):
    totals = late.LateTotals(spark, new_path(spark, "late"))
    totals.apply(hot(spark, [(0, "A", 10, False, 1, 1)]), 0)
    monkeypatch.setattr(late.LateTotals, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        totals.apply(hot(spark, [(0, "A", 100, False, 2, 2)]), 1)
    monkeypatch.undo()
    assert [r.wire for r in totals.read().collect()] == [10]
    totals.apply(hot(spark, [(0, "A", 100, False, 2, 2)]), 1)
    assert [r.wire for r in totals.read().collect()] == [110]


def test_a_closed_period_keeps_its_totals(spark):
    totals = late.LateTotals(spark, new_path(spark, "late"))
    totals.apply(hot(spark, [(0, "A", 100, False, 1, 1), (200, "A", 5, False, 2, 201)]), 0)
    totals.forget(int(at(180).timestamp() * 1e6))
    totals.apply(hot(spark, [(0, "A", 9, False, 3, 300), (1, "A", 7, False, 4, 60), (200, "A", 6, False, 5, 202)]), 1)
    assert {r.minute_us - int(T0.timestamp() * 1e6): r.wire for r in totals.read().collect()} == {0: 100, 200 * late.MINUTE_US: 11}
    assert totals.state().refused == 1  # the row in time for a closed period; the one past the cut-off is none


def test_batches_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(late, "PARTS", 2)
    totals = late.LateTotals(spark, new_path(spark, "late"))
    for batch, wire in ((5, 100), (3, 11), (4, 1), (9, 1000)):
        totals.apply(hot(spark, [(0, "A", wire, False, batch, 1)]), batch)
    assert totals.apply(hot(spark, [(0, "A", 11, False, 3, 1)]), 3) == []
    assert [r.wire for r in totals.read().collect()] == [1112]
    state = totals.state()
    assert state.applied == [[3, 5], [9, 9]] and [len(v) for v in state.raw.values()] == [2]  # three parts became one
    totals.forget(0)
    assert len(totals.commits.names("totals")) == 1 and len(totals.commits.names("commits")) <= 4
    totals.apply(hot(spark, [(0, "A", 1, False, 10, 1)]), 10)
    assert [r.wire for r in totals.read().collect()] == [1113]


def test_late_totals_of_nothing(spark):
    totals = late.replay(hot(spark, []), late.LateTotals(spark, new_path(spark, "late")))
    assert totals.read().count() == 0
    one, four = (late.replay(hot(spark, [(m, "A", m, False, m, m + m % 150) for m in range(300)]), late.LateTotals(spark, new_path(spark, "late")), n).read() for n in (1, 4))
    key = lambda df: sorted(map(tuple, df.select("minute_us", "app", "wire").collect()))
    assert key(one) == key(four)
