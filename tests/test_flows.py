"""Flows (Q1, Q6, Q8, Q9, Q10) on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cytotide.plans import (active_gating, bead_density, gridded_scatter, opp_selection,
                            ridgeline_flow, stat_metrics)

H = dt.datetime(2024, 1, 1, 10)


def _particles(spark):
    rows = [(H + dt.timedelta(minutes=m), 1000.0 + 10 * m, 50.0 + m, 20.0, 100.0 + m, 120.0 + m, 1.0, 2)
            for m in range(40)]
    rows.append((H + dt.timedelta(minutes=5), 500.0, 5.0, 5.0, 100.0, 900.0, 1.0, 2))   # misaligned
    cols = "time timestamp, fsc_small double, chl_small double, pe double, D1 double, D2 double, fid double, aid long"
    df = spark.createDataFrame(rows, cols)
    params = dict(width=100.0, notch_small_D1=0.5, offset_small_D1=0.0, notch_small_D2=0.5, offset_small_D2=0.0,
                  notch_large_D1=0.0, offset_large_D1=0.0, notch_large_D2=0.0, offset_large_D2=0.0)
    return df.withColumns({k: F.lit(v) for k, v in params.items()})


def test_bead_density_kinds(spark):
    p = _particles(spark)
    evt = bead_density(p, kind="evt")
    assert evt.agg(F.sum("n")).first()[0] == 40 * 4          # misaligned row dropped, four panels
    assert bead_density(p, kind="evt", align=False).agg(F.sum("n")).first()[0] == 41 * 4
    opp = bead_density(p, kind="opp")
    assert opp.agg(F.sum("n")).first()[0] == 40 * 4          # D <= 0.5 * fsc for every aligned row
    vct = bead_density(p.withColumn("filter_id", F.col("fid")).withColumn("active_filter_id", F.lit(1.0)),
                       kind="vct")
    assert vct.agg(F.sum("n")).first()[0] == 41 * 4
    with pytest.raises(ValueError):
        bead_density(p, kind="other")


def test_opp_selection_needs_anchors(spark):
    with pytest.raises(ValueError):
        opp_selection(_particles(spark), _particles(spark).limit(0), anchor="selected")


def test_gridded_scatter_and_ridgeline_range(spark):
    rows = [(H + dt.timedelta(hours=h), pop, 1.0 + h, 2.0, 3.0, n, 10.0 * n)
            for h in range(3) for pop, n in (("a", 1), ("a", 5), ("unknown", 2))]
    rows.append((H, "a", 0.0, 2.0, 3.0, 4, 1.0))                  # non-positive on a log axis
    df = spark.createDataFrame(rows, "date timestamp, pop string, fsc_small double, chl_small double, pe double, "
                                     "n long, Qc_sum double")
    sc = gridded_scatter(df, pops=["a"]).collect()
    assert len(sc) == 6 and {r.marker_size for r in sc} == {3.0, 18.0}
    r = ridgeline_flow(df, pops=["a"], per_hour=False, start=H + dt.timedelta(hours=1),
                       end=dt.datetime(2030, 1, 1))
    assert {x.date for x in r.collect()} == {H + dt.timedelta(hours=1), H + dt.timedelta(hours=2)}


def test_stat_metrics_and_active_gating_text(spark):
    stat = spark.createDataFrame(
        [(f"2024-01-01 10:{m:02d}:00", "p", 50.0, 0.1, 3, 1.0, 1.0, 1.0, 1.0, 2.0, f) for m, f in
         ((0, 0), (3, 1), (6, None))],
        "time string, pop string, quantile double, opp_evt_ratio double, n_count long, abundance double, "
        "fsc_med double, chl_med double, pe_med double, diam_mid_med double, flag int")
    hourly = stat_metrics(stat, hourly=True).first()
    assert hourly.n_count == 6 and hourly.time == H                   # flag 1 excluded, NULL flag kept
    iv = spark.createDataFrame([(H, None, 7)], "start_date timestamp, end_date timestamp, gating_id long")
    gating = spark.createDataFrame([(7, "a", "fsc_small", "pe")], "id long, pop string, channel1 string, channel2 string")
    pts = spark.createDataFrame([(H + dt.timedelta(minutes=3),)], "time timestamp")
    g = active_gating(pts, iv, gating).first()
    assert g.start_date == "2024-01-01T10:00:00Z" and g.end_date is None and g.pop == "a"


def test_quantile_sets_judge_each_particle_once(spark):
    from cytotide.operators import passed_quantiles, quantile_sets, replicate_quantiles, select_opp
    names = ["width", *[f"{a}_{k}_{d}" for k in ("small", "large") for d in ("D1", "D2") for a in ("notch", "offset")]]

    def row(i, q, width, offset):
        return (i, q, float(width), *[0.0 if n.startswith("notch") else float(offset) for n in names[1:]])
    rows = [row(1, 2.5, 1, 10), row(1, 50.0, 5, 10), row(1, 97.5, 50, 10), row(2, 50.0, 5, 1), row(3, 97.5, 50, 100), row(3, 97.5, 40, 100), row(4, 33.0, 5, 5)]
    params = spark.createDataFrame(rows, "id long, quantile double, " + ", ".join(f"{n} double" for n in names))
    sets = quantile_sets(params)
    assert {r.id: [(p["quantile"], p["width"]) for p in r.params] for r in sets.collect()} == {
        1: [(2.5, 1.0), (50.0, 5.0), (97.5, 50.0)], 2: [(50.0, 5.0)], 3: [(97.5, 40.0)]}
    particles = spark.createDataFrame([(n, i, 1.0, d1, d2) for n, (i, d1, d2) in enumerate(
        [(1, 5.0, 5.5), (1, 5.0, 8.0), (1, 9.0, 30.0), (2, 5.0, 5.0), (3, 5.0, 40.0), (4, 1.0, 1.0), (9, 1.0, 1.0), (1, None, 2.0)])],
        "n int, id long, fsc_small double, D1 double, D2 double")
    attached = particles.join(sets, "id", "left")
    assert {r.n: r.p for r in attached.select("n", passed_quantiles().alias("p")).collect()} == {
        0: [2.5, 50.0, 97.5], 1: [50.0, 97.5], 2: [], 3: [], 4: [97.5], 5: [], 6: [], 7: []}
    got = select_opp(attached, quantiles=(50, 97.5))
    assert "params" not in got.columns and {r.n: (r["q50"], r["q97.5"]) for r in got.collect()} == {0: (True, True), 1: (True, True), 4: (False, True)}
    # the same as a join with a copy of each particle and parameter row
    copies = particles.join(params.where("quantile in (2.5, 50, 97.5)"), "id")
    want = {(r.n, r["quantile"]) for r in select_opp(copies).collect()}
    assert {(r.n, q) for r in attached.select("n", passed_quantiles().alias("p")).collect() for q in r.p} == want
    assert replicate_quantiles(params.where("id = 1")).count() == 9


def test_polygons_meet_points_gate_by_gate_in_bounded_packs(spark, monkeypatch):
    """Packs smaller than a gate; repeated and null vertices stay, missing ids match nothing, and many tasks share a gate."""
    import datetime as dt

    from cytotide.plans import flows
    monkeypatch.setattr(flows, "POLYGON_VERTICES", 3)
    monkeypatch.setattr(flows, "POLYGON_SCOPES", 16)
    monkeypatch.setattr(flows, "POLYGON_SLICE", 8)
    monkeypatch.setattr(flows, "POLYGON_TASK_ROWS", 50)
    base = dt.datetime(2024, 1, 1)
    vertices = [("A", 1, float(i), "x") for i in range(40)] + [("A", 1, 5.0, "x"), ("A", 2, None, "y"), ("B", 1, -0.0, None), (None, 1, 1.0, "z"), ("A", None, 1.0, "z")]
    points = [("A", base + dt.timedelta(seconds=i), 1) for i in range(70)] + [("A", base, 2), ("A", base, None), ("B", base, 1), ("B", base, 1), ("B", base, 3)]
    poly = spark.createDataFrame(vertices, "cruise string, gating_id long, fsc_small double, pop string")
    active = spark.createDataFrame(points, "cruise string, time timestamp, gating_id long")
    out = flows.active_polygons(poly, active, by=["cruise"])
    assert out.columns == ["cruise", "gating_id", "fsc_small", "pop", "time"]
    want = sorted(((c, g, x, p, t) for c, g, x, p in vertices for d, t, h in set(points) if c is not None and c == d and g is not None and g == h), key=str)
    assert sorted(map(tuple, out.collect()), key=str) == want
    # gate (A, 1) has 41 * 70 rows: no task holds all of them
    per_task = out.where("cruise = 'A' and gating_id = 1").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sum(r["count"] for r in per_task) == 41 * 70 and max(r["count"] for r in per_task) < 41 * 70


def test_no_task_makes_a_whole_gate_however_many_points_it_has(spark, monkeypatch):
    """A gate of few vertices and many points is dealt to many tasks; a result beyond what the most tasks make has larger cells."""
    from cytotide.plans import flows
    monkeypatch.setattr(flows, "POLYGON_VERTICES", 3)
    monkeypatch.setattr(flows, "POLYGON_SCOPES", 16)
    monkeypatch.setattr(flows, "POLYGON_SLICE", 8)
    monkeypatch.setattr(flows, "POLYGON_TASK_ROWS", 200)
    base = dt.datetime(2024, 1, 1)
    poly = spark.createDataFrame([("A", 1, 0.5), ("A", 1, 0.5), ("A", 1, None), ("B", 1, 2.0)], "cruise string, gating_id int, fsc_small double")
    active = spark.createDataFrame([("A", base + dt.timedelta(seconds=i), 1) for i in range(2000)] + [("B", base, 1), ("B", base, 2), ("C", base, 1)],
                                   "cruise string, time timestamp, gating_id long")
    want = {("A", 1, 0.5, 2): 2000, ("A", 1, None, 1): 2000, ("B", 1, 2.0, 1): 1}
    for most, share in ((4000, 4), (4, 1.5)):
        monkeypatch.setattr(flows, "POLYGON_TASKS", most)
        out = flows.active_polygons(poly, active, by=["cruise"])
        assert out.dtypes == [("cruise", "string"), ("gating_id", "int"), ("fsc_small", "double"), ("time", "timestamp")]
        per_task = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in per_task) == 6001 and max(r["count"] for r in per_task) < 6001 / share
        per_time = out.groupBy(*out.columns).count().groupBy("cruise", "gating_id", "fsc_small", "count").agg(F.count("*").alias("times"))
        assert {tuple(r)[:4]: r.times for r in per_time.collect()} == want


def test_polygons_are_unpacked_a_slice_at_a_time(spark, monkeypatch):
    """A step of generated code holds all rows that it makes of one it reads, so vertices and points are unpacked in steps of
    their own, in as many partitions as were dealt; before, a pack's rows were all there before the first was returned."""
    import re

    from cytotide.plans import flows
    monkeypatch.setattr(flows, "POLYGON_TASK_ROWS", 3000)
    base = dt.datetime(2024, 1, 1)
    poly = spark.createDataFrame([(1, float(i)) for i in range(100)], "gating_id int, fsc_small double")
    active = spark.createDataFrame([(base + dt.timedelta(seconds=i), 1) for i in range(300)], "time timestamp, gating_id long")
    out = flows.active_polygons(poly, active)
    assert out.select("fsc_small", "time").distinct().count() == out.count() == 100 * 300 and out.rdd.getNumPartitions() == 11
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    steps = re.findall(r"\*\((\d+)\) Generate (?:explode|inline)\((__vertices|__scopes)#", plan)
    assert [column for _, column in steps] == ["__scopes", "__vertices"] and steps[0][0] != steps[1][0]
