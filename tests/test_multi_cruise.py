"""Keyed (multi-cruise) forms of the operators: every cruise must get exactly the
answer it would get alone."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cytotide.operators import (active_at, hex_counts, log_bin_counts, rescale, to_intervals,
                                value_range)

BASE = dt.datetime(2024, 1, 1)


def _rows(seed, cruise, n):
    rnd = random.Random(seed)
    return [(cruise, BASE + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 5)), rnd.randrange(0, 9))
            for _ in range(n)]


def test_keyed_intervals_and_as_of_equal_per_cruise(spark):
    plan = spark.createDataFrame(_rows(1, "A", 40) + _rows(2, "B", 25),
                                 "cruise string, start_date timestamp, filter_id long")
    caps = spark.createDataFrame([("A", BASE + dt.timedelta(days=4)), ("B", BASE + dt.timedelta(days=6))],
                                 "cruise string, max_time timestamp")
    pts = spark.createDataFrame([(c, BASE + dt.timedelta(minutes=m)) for c in "AB" for m in range(0, 60 * 24 * 7, 97)],
                                "cruise string, time timestamp")
    iv_all = to_intervals(plan, by=["cruise"], tiebreak=["filter_id"], max_time=caps)
    got = {(r.cruise, r.time): r.filter_id for r in active_at(pts, iv_all, by=["cruise"]).collect()}
    for c in "AB":
        iv_one = to_intervals(plan.where(F.col("cruise") == c).drop("cruise"), tiebreak=["filter_id"],
                              max_time=caps.where(F.col("cruise") == c).first().max_time)
        one = active_at(pts.where(F.col("cruise") == c).drop("cruise"), iv_one)
        for r in one.collect():
            assert got[(c, r.time)] == r.filter_id


def test_keyed_density_and_ranges_equal_per_cruise(spark):
    rnd = random.Random(9)
    rows = [(c, rnd.choice(["chl", "pe"]), rnd.uniform(1, 500) * (3 if c == "B" else 1), rnd.uniform(1, 80))
            for c in "AB" for _ in range(400)]
    df = spark.createDataFrame(rows, "cruise string, panel string, fsc_small double, y_value double")
    keyed = {(r.cruise, r.panel, r.lattice, r.i, r.j): r.n for r in hex_counts(df, by=["cruise"]).collect()}
    logs = {(r.cruise, r.ix, r.iy): r.n for r in
            log_bin_counts(df.withColumn("pop", F.lit("beads")), "fsc_small", "y_value", by=["cruise"]).collect()}
    for c in "AB":
        alone = df.where(F.col("cruise") == c).drop("cruise")
        for r in hex_counts(alone).collect():
            assert keyed[(c, r.panel, r.lattice, r.i, r.j)] == r.n
        for r in log_bin_counts(alone.withColumn("pop", F.lit("beads")), "fsc_small", "y_value").collect():
            assert logs[(c, r.ix, r.iy)] == r.n
    assert sum(keyed.values()) == len(rows)
    scaled = rescale(df, "fsc_small", by=["cruise"])
    ranges = {r.cruise: (r.marker_size_min, r.marker_size_max)
              for r in value_range(scaled, ["marker_size"], by=["cruise"]).collect()}
    assert all(abs(lo - 3.0) < 1e-9 and abs(hi - 18.0) < 1e-9 for lo, hi in ranges.values())


def test_points_and_plan_from_one_table(spark):
    # Regression: probe and plan share lineage (both derived from one frame).
    src = spark.createDataFrame(_rows(4, "A", 50) + _rows(5, "B", 50),
                                "cruise string, time timestamp, filter_id long")
    plan = src.where(F.col("filter_id") < 3).select("cruise", F.col("time").alias("start_date"), "filter_id")
    iv = to_intervals(plan, by=["cruise"], tiebreak=["filter_id"])
    out = active_at(src.select("cruise", "time"), iv, by=["cruise"])
    assert out.count() >= src.select("cruise", "time").distinct().count()
    ivs = iv.collect()
    for r in out.collect():
        want = {x.filter_id for x in ivs if x.cruise == r.cruise and x.start_date <= r.time
                and (x.end_date is None or r.time < x.end_date)} or {None}
        assert r.filter_id in want
