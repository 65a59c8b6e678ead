"""Plans, intervals and range joins (W1 W2 W3 J1 J5 J6 J7 D2; traps T6 T8), with
brute-force checks of the bucketed joins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cruise_helpers import ts
from cytotide.operators import (active_at, active_in_hour, active_rows, conflicting_gates, last_match,
                                to_intervals, with_params)


def _plan(spark, rows):
    return spark.createDataFrame(rows, "start_date timestamp, filter_id long")


def test_lead_intervals_and_max_cap(spark):
    plan = _plan(spark, [(ts("2024-01-01 00:00:00"), 1), (ts("2024-01-03 00:00:00"), 2),
                         (ts("2024-01-02 00:00:00"), 3)])
    iv = to_intervals(plan, tiebreak=["filter_id"], max_time=ts("2024-01-05 00:00:00"))
    got = {r.filter_id: (r.start_date, r.end_date) for r in iv.collect()}
    assert got[1] == (ts("2024-01-01 00:00:00"), ts("2024-01-02 00:00:00"))
    assert got[3] == (ts("2024-01-02 00:00:00"), ts("2024-01-03 00:00:00"))
    assert got[2] == (ts("2024-01-03 00:00:00"), ts("2024-01-05 00:00:00"))


def test_null_start_sorts_last_T8(spark):
    # R orders NA last: the last non-NULL start stays open and the NULL row takes the cap.
    plan = _plan(spark, [(ts("2024-01-01 00:00:00"), 1), (None, 2), (ts("2024-01-02 00:00:00"), 3)])
    iv = {r.filter_id: r.end_date for r in
          to_intervals(plan, tiebreak=["filter_id"], max_time=ts("2024-01-09 00:00:00")).collect()}
    assert iv[1] == ts("2024-01-02 00:00:00") and iv[3] is None and iv[2] == ts("2024-01-09 00:00:00")


def test_lead_across_buckets_and_keys(spark):
    rows = [("a", ts("2024-01-01 00:00:00"), 1), ("a", ts("2024-01-10 05:00:00"), 2),
            ("b", ts("2024-01-01 00:00:00"), 3), ("a", ts("2024-01-10 06:00:00"), 4)]
    plan = spark.createDataFrame(rows, "cruise string, start_date timestamp, filter_id long")
    got = {r.filter_id: r.end_date for r in to_intervals(plan, by=["cruise"], tiebreak=["filter_id"]).collect()}
    assert got == {1: ts("2024-01-10 05:00:00"), 2: ts("2024-01-10 06:00:00"), 3: None, 4: None}


def test_intervals_do_not_overlap_property(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 20)), i) for i in range(300)]
    iv = to_intervals(_plan(spark, rows), tiebreak=["filter_id"]).orderBy("start_date", "filter_id").collect()
    # In start order each interval ends exactly where the next starts: none overlap.
    for a, b in zip(iv, iv[1:]):
        assert a.end_date == b.start_date
    assert iv[-1].end_date is None


def test_last_instant_matches_nothing_T6(spark):
    plan = _plan(spark, [(ts("2024-01-01 00:00:00"), 1)])
    iv = to_intervals(plan, max_time=ts("2024-01-02 00:00:00"))
    pts = spark.createDataFrame([(ts("2024-01-02 00:00:00"),), (ts("2024-01-01 12:00:00"),)], "time timestamp")
    got = {r.time: r.filter_id for r in active_at(pts, iv).collect()}
    assert got[ts("2024-01-02 00:00:00")] is None and got[ts("2024-01-01 12:00:00")] == 1


def test_active_at_matches_brute_force(spark):
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    plan_rows = [(base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 10)), i % 7) for i in range(60)]
    plan_rows.append((None, 99))
    iv = to_intervals(_plan(spark, plan_rows), tiebreak=["filter_id"],
                      max_time=base + dt.timedelta(days=9))
    ivs = [(r.start_date, r.end_date, r.filter_id) for r in iv.collect()]
    pts = [(base + dt.timedelta(minutes=rnd.randrange(-100, 60 * 24 * 12)),) for _ in range(500)]
    got, rows_per_point = {}, {}
    joined = active_at(spark.createDataFrame(pts, "time timestamp").distinct(), iv).collect()
    for r in joined:
        got.setdefault(r.time, set()).add(r.filter_id)
        rows_per_point[r.time] = rows_per_point.get(r.time, 0) + 1
    # Property: non-overlapping plan intervals give at most one row per point.
    assert max(rows_per_point.values()) == 1
    for (t,) in pts:
        want = {f for s, e, f in ivs if s is not None and s <= t and (e is None or t < e)} or {None}
        assert got[t] == want


def test_active_in_hour_matches_brute_force(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    plan_rows = [(base + dt.timedelta(minutes=rnd.randrange(0, 60 * 48)), i) for i in range(40)]
    iv = to_intervals(_plan(spark, plan_rows), tiebreak=["filter_id"])
    ivs = [(r.start_date, r.end_date, r.filter_id) for r in iv.collect()]
    hours = [(base + dt.timedelta(hours=h),) for h in range(-2, 60)]
    got = {}
    for r in active_in_hour(spark.createDataFrame(hours, "hour timestamp"), iv).collect():
        got.setdefault(r.hour, set()).add(r.filter_id)
    for (h,) in hours:
        want = {f for s, e, f in ivs if s < h + dt.timedelta(hours=1) and (e is None or e > h)}
        assert got.get(h, set()) == want


def test_with_params_last_match_and_conflicts(spark):
    plan = _plan(spark, [(ts("2024-01-01 00:00:00"), 1), (ts("2024-01-02 00:00:00"), 2)])
    params = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id long, width double")
    iv = with_params(to_intervals(plan, tiebreak=["filter_id"]), params)
    assert set(iv.columns) == {"start_date", "filter_id", "end_date", "width"}
    # Two overlapping intervals: W3 keeps the later start.
    over = spark.createDataFrame([(ts("2024-01-01 00:00:00"), None, 1), (ts("2024-01-01 06:00:00"), None, 2)],
                                 "start_date timestamp, end_date timestamp, gating_id long")
    pts = spark.createDataFrame([(ts("2024-01-01 12:00:00"),)], "time timestamp")
    hit = active_at(pts, over)
    assert last_match(hit, ["time"]).first().gating_id == 2
    assert conflicting_gates(hit, ["time"]).first().n_active == 2
    poly = spark.createDataFrame([(1, "a"), (3, "b"), (None, "c")], "gating_id long, pop string")
    assert [r.pop for r in active_rows(poly, hit, "gating_id").collect()] == ["a"]


def test_colliding_ids_of_two_cruises(spark):
    plan = spark.createDataFrame([("A", ts("2024-01-01 00:00:00"), 1), ("B", ts("2024-01-01 00:00:00"), 1)],
                                 "cruise string, start_date timestamp, filter_id long")
    params = spark.createDataFrame([("A", 1, 10.0), ("B", 1, 20.0)], "cruise string, id long, width double")
    got = with_params(to_intervals(plan, by=["cruise"]), params, by=["cruise"]).collect()
    assert sorted((r.cruise, r.width) for r in got) == [("A", 10.0), ("B", 20.0)]


def test_an_absurdly_long_interval_explodes_in_proportion(spark):
    from cytotide.operators.intervals import _explode_intervals
    iv = spark.createDataFrame([(ts("1700-01-01 00:00:00"), ts("2300-01-01 00:00:00"), 1), (ts("2024-01-01 00:10:00"), ts("2024-01-01 00:20:00"), 2),
                                (ts("2024-01-01 00:15:00"), None, 3)], "start_date timestamp, end_date timestamp, filter_id long")
    exploded, *_ = _explode_intervals(iv.selectExpr("*", "filter_id AS __iv"), "start_date", "end_date", [], 3_600_000_000)
    assert exploded.count() <= 16 * 3 + 100_000
    pts = spark.createDataFrame([(ts("2024-01-01 00:12:00"),), (ts("2024-01-01 00:16:00"),), (ts("1699-01-01 00:00:00"),)], "time timestamp")
    got = sorted(((str(r.time), r.filter_id) for r in active_at(pts, iv).collect()), key=str)
    assert got == sorted([("2024-01-01 00:12:00", 1), ("2024-01-01 00:12:00", 2), ("2024-01-01 00:16:00", 1), ("2024-01-01 00:16:00", 2),
                          ("2024-01-01 00:16:00", 3), ("1699-01-01 00:00:00", None)], key=str)


def test_an_interval_without_length_is_active_in_its_hour(spark):
    iv = spark.createDataFrame([(ts("2024-01-01 10:10:00"), ts("2024-01-01 10:10:00"), 1)], "start_date timestamp, end_date timestamp, gating_id long")
    hours = spark.createDataFrame([(ts("2024-01-01 10:00:00"),), (ts("2024-01-01 11:00:00"),)], "hour timestamp")
    assert [r.hour for r in active_in_hour(hours, iv).collect()] == [ts("2024-01-01 10:00:00")]


def test_text_and_epoch_plan_dates(spark):
    from cytotide.plans import filter_intervals, gating_intervals
    params = spark.createDataFrame([("A", 1, 5.0)], "cruise string, id long, width double")
    plan = spark.createDataFrame([("A", "2024-01-01 00:05", 1), ("A", "junk", 1), ("B", "2024-01-01 00:05:30", 1), ("B", "2024-01-01 00:07", 1)],
                                 "cruise string, start_date string, filter_id long")
    got = sorted(((r.cruise, r.start_date, r.width) for r in filter_intervals(plan, params, by=["cruise"]).collect()), key=str)
    assert got == sorted([("A", ts("2024-01-01 00:05:00"), 5.0), ("A", None, 5.0), ("B", ts("2024-01-01 00:05:30"), None), ("B", None, None)], key=str)
    epoch = spark.createDataFrame([(1704067200, 3), (1704070800, 4)], "start_date long, gating_id long")
    assert {r.gating_id: (r.start_date, r.end_date) for r in gating_intervals(epoch).collect()} == {
        3: (ts("2024-01-01 00:00:00"), ts("2024-01-01 01:00:00")), 4: (ts("2024-01-01 01:00:00"), None)}


def test_intervals_that_differ_in_which_parameter_is_null(spark):
    start, end = ts("2024-01-01 00:00:00"), ts("2024-01-02 00:00:00")
    iv = spark.createDataFrame([(start, end, 5.0, None), (start, end, None, 5.0)],
                               "start_date timestamp, end_date timestamp, beads_D1 double, beads_D2 double")
    points = spark.createDataFrame([(ts("2024-01-01 12:00:00"),)], "time timestamp")
    got = active_at(points, iv).collect()
    assert {(r.beads_D1, r.beads_D2) for r in got} == {(5.0, None), (None, 5.0)} and len(got) == 2


def test_nested_parameters_are_not_broadcast_by_an_estimate(spark):
    from cytotide.operators import quantile_sets
    params = spark.createDataFrame([(i, q, i * q) for i in range(4) for q in (2.5, 50.0, 97.5)], "id long, quantile double, width double")
    plan = _plan(spark, [(ts("2024-01-01 00:00:00"), 1), (ts("2024-01-02 00:00:00"), 3), (ts("2024-01-03 00:00:00"), 9)])
    iv = with_params(plan, quantile_sets(params))
    rows = iv.collect()
    assert "BroadcastHashJoin" not in iv._jdf.queryExecution().executedPlan().toString()
    assert {r.filter_id: r.params and [p.width for p in r.params] for r in rows} == {1: [2.5, 50.0, 97.5], 3: [7.5, 150.0, 292.5], 9: None}


def test_a_dense_plan_gets_narrow_buckets(spark):
    from cytotide.operators.intervals import _explode_intervals
    base = dt.datetime(2024, 1, 1)
    iv = to_intervals(_plan(spark, [(base + dt.timedelta(seconds=i), i % 3) for i in range(7200)]), tiebreak=["filter_id"])
    exploded, *_ = _explode_intervals(iv.selectExpr("*", "filter_id AS __iv"), "start_date", "end_date", [], 3_600_000_000, points=True)
    assert exploded.groupBy("__b").count().agg(F.max("count")).first()[0] <= 8
    pts = spark.createDataFrame([(base + dt.timedelta(seconds=i, milliseconds=500),) for i in range(-2, 7300, 97)], "time timestamp")
    got = {r.time: (r.start_date, r.filter_id) for r in active_at(pts, iv).collect()}
    for (t,) in pts.collect():
        k = min(int((t - base).total_seconds()), 7199)
        assert got[t] == ((None, None) if t < base else (base + dt.timedelta(seconds=k), k % 3))


def test_intervals_without_length_are_not_carried_to_points(spark):
    """Starts that repeat make intervals without length; the parameters stay one row for each set of values."""
    rows = [(ts("2024-01-01 00:00:00"), 1)] * 50 + [(ts("2024-01-01 01:00:00"), 2)] * 50
    params = spark.createDataFrame([(1, 0.5), (2, None), (2, 7.0)], "id long, width double")
    iv = with_params(to_intervals(_plan(spark, rows), tiebreak=["filter_id"]), params)
    pts = spark.createDataFrame([(ts("2023-12-31 00:00:00"),), (ts("2024-01-01 00:30:00"),), (ts("2024-01-01 00:30:00"),), (ts("2024-01-01 01:00:00"),)], "time timestamp")
    got = sorted(((str(r.time), r.filter_id, r.width) for r in active_at(pts, iv).collect()), key=str)
    assert got == sorted([("2023-12-31 00:00:00", None, None), ("2024-01-01 00:30:00", 1, 0.5), ("2024-01-01 00:30:00", 1, 0.5),
                          ("2024-01-01 01:00:00", 2, None), ("2024-01-01 01:00:00", 2, 7.0)], key=str)
