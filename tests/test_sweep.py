"""Sweeps (as-of, hour overlap, lead, active ids) against brute force: several keys and none, ties, nulls, long intervals."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cruise_helpers import ts
from cytotide.operators import active_at, active_ids, active_in_hour, as_of, gate_conflicts, to_intervals

BASE = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else BASE + dt.timedelta(minutes=minutes)


def plan_rows(rnd, keys, n, span):
    return [(rnd.choice(keys), at(rnd.choice([rnd.randrange(span), rnd.randrange(span), rnd.randrange(0, span, 40), None if rnd.random() < 0.2 else 7])), i)
            for i in range(n)]


def lead_of(rows):
    """(key, start, end, id) in start order, nulls last, then id."""
    out = []
    for key in {k for k, _, _ in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or BASE, r[2]))
        out += [(key, s, (mine[i + 1][1] if s is not None and i + 1 < len(mine) else None), v) for i, (_, s, v) in enumerate(mine)]
    return out


@pytest.mark.parametrize("keys", [[None], ["a"], ["a", "b", None, "c"]])
def test_lead_and_as_of_equal_brute_force(spark, keys):
    rnd = random.Random(len(keys))
    rows = plan_rows(rnd, keys, 250, 3000)
    by = ["cruise"] if len(keys) > 1 else []
    df = spark.createDataFrame(rows, "cruise string, start_date timestamp, filter_id long")
    iv = to_intervals(df if by else df.drop("cruise"), by=by, tiebreak=["filter_id"])
    want = lead_of(rows)
    got = Counter((r.cruise if by else keys[0], r.start_date, r.end_date, r.filter_id) for r in iv.collect())
    assert got == Counter(want)
    points = [(k, at(rnd.randrange(-50, 3200))) for k in keys for _ in range(200)] + [(keys[0], None), (keys[0], at(7)), (keys[0], at(7))]
    pts = spark.createDataFrame(points, "cruise string, time timestamp")
    pts = pts if by else pts.drop("cruise")
    hit = {(r.cruise if by else keys[0], r.time): r.filter_id for r in as_of(pts, iv, by=by).collect()}
    inside = {(k, t): v for k, t in set(points) if t is not None
              for key, s, e, v in want if key == k and s is not None and s <= t and (e is None or t < e)}
    assert hit == inside
    joined = active_at(pts.withColumn("extra", F.lit(1)), iv, by=by, disjoint=True).collect()
    assert len(joined) == len(points) and all(r.filter_id == inside.get((r.cruise if by else keys[0], r.time)) for r in joined)
    hours = pts.select(*by, F.date_trunc("hour", "time").alias("hour")).where("hour is not null").distinct()
    over = Counter((r.cruise if by else keys[0], r.hour, r.filter_id) for r in active_in_hour(hours, iv, by=by, disjoint=True).collect())
    hour = dt.timedelta(hours=1)
    assert over == Counter((k, h, v) for k, h in {(k, t.replace(minute=0)) for k, t in points if t} for key, s, e, v in want
                           if key == k and s is not None and s < h + hour and (e is None or e > h))


def test_nothing_is_exploded_and_no_window_is_unkeyed_over_rows(spark):
    rows = [(at(i), i) for i in range(50)]
    iv = to_intervals(spark.createDataFrame(rows, "start_date timestamp, filter_id long"), tiebreak=["filter_id"])
    plan = as_of(spark.createDataFrame([(at(3),)], "time timestamp"), iv)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_one_interval_of_fifty_years_and_many_short_ones(spark):
    n = 100_000
    start = F.timestamp_seconds(F.lit(int(ts("2024-01-01 00:00:00").replace(tzinfo=dt.timezone.utc).timestamp())) + F.col("id") * 60)
    plan = spark.range(n).select(start.alias("start_date"), F.col("id").alias("gating_id")).unionByName(
        spark.createDataFrame([(ts("1974-01-01 00:00:00"), -1)], "start_date timestamp, gating_id long"))
    iv = to_intervals(plan, tiebreak=["gating_id"])
    points = spark.createDataFrame([(ts("1973-12-31 23:59:59"), None), (ts("1974-01-01 00:00:00"), -1), (ts("2023-12-31 23:59:59"), -1),
                                    (ts("2024-01-01 00:00:59"), 0), (ts("2024-01-01 05:00:30"), 300), (ts("2124-01-01 00:00:00"), n - 1)],
                                   "time timestamp, want long")
    got = active_at(points, iv, disjoint=True).collect()
    assert len(got) == 6 and all(r.gating_id == r.want for r in got)
    # the same with overlaps: the long interval lies under all short ones, which repeat three ids
    spans = (spark.range(n).select(start.alias("start_date"), (start + F.expr("INTERVAL 60 SECONDS")).alias("end_date"), (F.col("id") % 3).alias("gating_id"))
             .unionByName(spark.createDataFrame([(ts("1974-01-01 00:00:00"), ts("2024-02-01 00:00:00"), 9)], "start_date timestamp, end_date timestamp, gating_id long")))
    found = {r.time: r.n_active for r in active_ids(points, spans).collect()}
    assert found == {ts("1974-01-01 00:00:00"): 1, ts("2023-12-31 23:59:59"): 1, ts("2024-01-01 00:00:59"): 2, ts("2024-01-01 05:00:30"): 2}


@pytest.mark.parametrize("by", [[], ["cruise"]])
def test_active_ids_equal_brute_force(spark, by):
    rnd = random.Random(5)
    keys = ["a", "b"] if by else ["a"]
    rows = []
    for _ in range(160):
        s = rnd.randrange(0, 600)
        rows.append((rnd.choice(keys), at(s) if rnd.random() > 0.05 else None, at(s + rnd.choice([0, 5, 5, 60, 200, -3])) if rnd.random() > 0.1 else None,
                     rnd.choice([1, 1, 2, 3, None])))
    points = [(k, at(rnd.randrange(-10, 800))) for k in keys for _ in range(150)] + [("a", None)]
    iv = spark.createDataFrame(rows, "cruise string, start_date timestamp, end_date timestamp, gating_id long")
    pts = spark.createDataFrame(points, "cruise string, time timestamp")
    got = {(r.cruise if by else "a", r.time): r.n_active for r in active_ids(pts, iv, by=by).collect()}
    want = {}
    for k, t in set(points):
        ids = {v for key, s, e, v in rows if (key == k or not by) and t and s is not None and s <= t and (e is None or t < e)}
        if ids:
            want[k, t] = len(ids)
    assert got == want
    conflicts = {(r.cruise if by else "a", r.time): r.n_active for r in gate_conflicts(pts, iv, by=by).collect()}
    assert conflicts == {k: n for k, n in want.items() if n > 1} and 0 < len(conflicts) < len(want)


def test_parts_hand_on_values_without_moving_rows_again(spark):
    """Parts given by hand, so that every key has many; keys and values may be null. No join follows the windows."""
    from cytotide.operators.sweep import PART, carried, following, running_sum
    rnd = random.Random(3)
    rows = [(k, t, None if rnd.random() < 0.8 else t * 10, 1, t // 4) for k in ("a", None) for t in range(40) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, f"cruise string, t long, v long, one long, {PART} long").withColumn("w", F.when(F.col("v").isNotNull(), F.struct("v")))
    by, order = ["cruise"], ["t"]
    seen = carried(df, by, order, {"v": "last", "w": "whole"})
    nexts, sums = following(df, by, order, "v", "next"), running_sum(df, by, order, "one", "n")
    assert seen.columns == [*df.columns, "last", "whole"] and nexts.columns == [*df.columns, "next"] and sums.columns == [*df.columns, "n"]
    got = {(r.cruise, r.t): (r.last, r.whole and r.whole.v) for r in seen.collect()}
    after = {(r.cruise, r.t): r.next and (r.next.value,) for r in nexts.collect()}
    n = {(r.cruise, r.t): r.n for r in sums.collect()}
    assert len(got) == len(after) == len(n) == len(rows) == seen.count() == nexts.count() == sums.count()
    for key in ("a", None):
        last, mine = None, [r for r in rows if r[0] == key]
        for i, (_, t, v, _, _) in enumerate(mine):
            last = v if v is not None else last
            assert got[key, t] == (last, last) and n[key, t] == i + 1
            assert after[key, t] == ((mine[i + 1][2],) if i + 1 < len(mine) else None)
    assert not any("Join" in x._jdf.queryExecution().toString() for x in (seen, nexts, sums))


def test_distinct_points_are_not_joined_back(spark):
    iv = to_intervals(spark.createDataFrame([("a", at(0), 1), ("a", at(5), 2), (None, at(3), 3), ("a", None, 4)], "cruise string, start_date timestamp, gating_id long"),
                      by=["cruise"], tiebreak=["gating_id"])
    points = spark.createDataFrame([(at(t), k) for k in ("a", None) for t in (-1, 0, 4, 5, 99)] + [(None, "a")], "time timestamp, cruise string")
    plain = active_at(points, iv, by=["cruise"], how="inner", disjoint=True)
    swept = active_at(points, iv, by=["cruise"], how="inner", disjoint=True, distinct=True)
    assert swept.dtypes == plain.dtypes and Counter(swept.collect()) == Counter(plain.collect()) and swept.count() == 7
    assert {(r.cruise, r.time, r.start_date, r.end_date) for r in swept.where("gating_id < 3").collect()} == {
        ("a", at(0), at(0), at(5)), ("a", at(4), at(0), at(5)), ("a", at(5), at(5), None), ("a", at(99), at(5), None)}
    assert "Join" not in swept._jdf.queryExecution().toString()
