"""Aggregations, density bins, grid decoding, gating and guide lines (A1-A11, A5, A6,
W4, J8, J11, Q2; traps T3 T4 T5), with brute-force checks of the bin rules."""

import math
import random

from pyspark.sql import functions as F

from cruise_helpers import ts
from cytotide.operators import (decode_bins, flags_present, gate_centroids, gate_outlines, guide_segments,
                                hex_counts, hex_counts_panels, hourly_stat, log_bin_counts, ordered, populations, rescale,
                                ridgeline, series_arrays, sfl_only_count)


def test_hourly_stat_median_and_empty_sum_T4(spark):
    rows = [(ts("2024-01-01 10:03:00"), "p", 1.0, None), (ts("2024-01-01 10:06:00"), "p", 3.0, None),
            (ts("2024-01-01 10:09:00"), "p", None, None), (ts("2024-01-01 11:00:00"), "p", 5.0, 7)]
    df = spark.createDataFrame(rows, "time timestamp, pop string, abundance double, n_count long")
    out = {r.time: r for r in hourly_stat(df, medians=["abundance"]).collect()}
    assert out[ts("2024-01-01 10:00:00")].abundance == 2.0
    assert out[ts("2024-01-01 10:00:00")].n_count == 0
    assert out[ts("2024-01-01 11:00:00")].n_count == 7


def test_ridgeline_missing_propagates_T5(spark):
    df = spark.createDataFrame([(1, "p", 1.0, 2, 1.5), (1, "p", 1.0, None, 2.5), (1, "p", 2.0, 3, 1.0)],
                               "date int, pop string, x double, n long, Qc_sum double")
    got = {r.x: (r.n, r.Qc_sum) for r in ridgeline(df, "x").collect()}
    assert got[1.0] == (None, 4.0) and got[2.0] == (3, 1.0)
    s = series_arrays(ridgeline(df, "x"), "x", "Qc_sum").first()
    assert s.x == [1.0, 2.0] and s.height == [4.0, 1.0]


def test_set_ops_and_populations(spark):
    sfl = spark.createDataFrame([(ts("2024-01-01 00:00:00"), 1), (ts("2024-01-01 00:03:00"), 2), (None, None)],
                                "time timestamp, flag int")
    stat = spark.createDataFrame([(ts("2024-01-01 00:00:00"), 1.0)], "time timestamp, flag double")
    assert sfl_only_count(sfl, stat).first().n == 2  # includes the missing time, like setdiff
    assert sorted(r.flag for r in flags_present(sfl, stat).collect()) == ["1", "2"]
    pops = spark.createDataFrame([("unknown",), ("a",), (None,)], "pop string")
    assert {r.pop: r.selected for r in populations(pops).collect()} == {"unknown": False, "a": True}
    only_unknown = spark.createDataFrame([("unknown",)], "pop string")
    assert populations(only_unknown).first().selected is True


def _hex_brute(x, y, x0, x1, y0, y1, bins=110):
    wx = (x1 - x0) / bins if x1 > x0 else 1.0
    wy = (y1 - y0) / bins if y1 > y0 else 1.0
    u, v = (x - x0) / wx, (y - y0) / (1.7320508075688772 * wy)
    ia, ja, ib, jb = math.floor(u + 0.5), math.floor(v + 0.5), math.floor(u), math.floor(v)
    da = (u - ia) * (u - ia) + 3.0 * ((v - ja) * (v - ja))
    db = (u - ib - 0.5) * (u - ib - 0.5) + 3.0 * ((v - jb - 0.5) * (v - jb - 0.5))
    return (0, ia, ja) if da <= db else (1, ib, jb)


def test_hex_counts_brute_force_and_total(spark):
    rnd = random.Random(5)
    pts = [(rnd.choice(["p1", "p2"]), rnd.uniform(0, 1000), rnd.gauss(50, 20)) for _ in range(2000)]
    df = spark.createDataFrame(pts, "panel string, fsc_small double, y_value double")
    got = {(r.panel, r.lattice, r.i, r.j): r.n for r in hex_counts(df).collect()}
    assert sum(got.values()) == len(pts)
    x0, x1 = min(p[1] for p in pts), max(p[1] for p in pts)
    want = {}
    for panel in ("p1", "p2"):
        ys = [p[2] for p in pts if p[0] == panel]
        for p in pts:
            if p[0] == panel:
                k = (panel,) + _hex_brute(p[1], p[2], x0, x1, min(ys), max(ys))
                want[k] = want.get(k, 0) + 1
    assert got == want


def test_log_bins_unknown_label_and_total(spark):
    rows = [("prochloro", 10.0, 100.0), ("weird", 1000.0, 10.0), (None, 1.0, 1.0), ("beads", 0.0, 5.0)]
    df = spark.createDataFrame(rows, "pop string, fsc_small double, pe double")
    out = log_bin_counts(df, "fsc_small", "pe").collect()
    assert sum(r.n for r in out) == 3  # x <= 0 removed
    assert {r.pop for r in out} == {"prochloro", None}
    assert max(r.ix for r in out) == 139 and min(r.ix for r in out) == 0
    nopop = log_bin_counts(df.drop("pop"), "fsc_small", "pe").collect()
    assert {r.pop for r in nopop} == {"unknown"}


def test_rescale_flat_and_linear(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 10.0), (2, 5.0)], "h int, v double")
    got = sorted((r.h, r.v, r.marker_size) for r in rescale(df, "v", by=["h"]).collect())
    assert got == [(1, 0.0, 3.0), (1, 10.0, 18.0), (2, 5.0, 10.0)]


def test_decode_bins_one_based_T3(spark):
    bins = spark.createDataFrame([(1, 10.0, 1.0, 0.1, 0.5), (2, 20.0, 2.0, 0.2, 1.0)],
                                 "idx long, fsc_small double, chl_small double, pe double, Qc double")
    g = spark.createDataFrame([(1, 2, 0, 3, 5)], "fsc_small_coord int, chl_small_coord int, pe_coord int, Qc_coord int, n long")
    r = decode_bins(g, bins).first()
    assert (r.fsc_small, r.chl_small, r.pe, r.Qc) == (10.0, 2.0, None, None)
    assert "fsc_small_coord" not in decode_bins(g, bins).columns


def test_gate_outlines_set_equal_channels(spark):
    gating = spark.createDataFrame([(1, "a", "pe", "fsc_small", 1), (1, "b", "fsc_small", None, 2),
                                    (1, "c", "fsc_small", "chl_small", 3)],
                                   "id long, pop string, channel1 string, channel2 string, pop_order int")
    poly = spark.createDataFrame([(1, "a", 1.0, 2.0, 9.0, 1), (1, "a", 3.0, 4.0, 9.0, 2), (1, "b", 0.0, 0.0, 0.0, 1)],
                                 "gating_id long, pop string, fsc_small double, pe double, chl_small double, point_order int")
    o = gate_outlines(gating, poly, [("fsc_small", "pe")])
    assert sorted(r.x for r in o.collect()) == [1.0, 3.0]
    c = gate_centroids(o).first()
    assert (c.x, c.y, c.pop_order) == (2.0, 3.0, 1)


def test_guide_segments_split_and_parallel(spark):
    p = spark.createDataFrame([(1, 1.0, 0.0, 0.5, 10.0, 1.0, 0.0, 1.0, 5.0)],
                              "filter_id long, notch_small_D1 double, offset_small_D1 double, notch_large_D1 double, "
                              "offset_large_D1 double, notch_small_D2 double, offset_small_D2 double, "
                              "notch_large_D2 double, offset_large_D2 double")
    seg = {(r.panel, r.line_kind): (r.x_start, r.x_end) for r in guide_segments(p, x_range=(0.0, 100.0)).collect()}
    # Lines cross at x = 20; D2: parallel -> only the large segment, from x_min.
    assert seg[("D1 vs fsc_small", "small")] == (0.0, 20.0)
    assert seg[("D1 vs fsc_small", "large")] == (20.0, 100.0)
    assert ("D2 vs fsc_small", "small") not in seg and seg[("D2 vs fsc_small", "large")] == (0.0, 100.0)


def test_medians_of_missing_keys_infinities_and_a_huge_group(spark):
    inf = float("inf")
    rows = [(ts("2024-01-01 10:00:00"), "p", float(i)) for i in range(20_001)]
    rows += [(None, "p", 2.0), (ts("2024-01-01 10:00:00"), None, 4.0), (ts("2024-01-01 10:03:00"), None, float("nan")),
             (ts("2024-01-01 12:00:00"), "p", inf), (ts("2024-01-01 12:01:00"), "p", 1.0), (ts("2024-01-01 12:02:00"), "p", 3.0)]
    df = spark.createDataFrame(rows, "time timestamp, pop string, abundance double").selectExpr("*", "1L AS n_count")
    out = {(r.time, r.pop): r.abundance for r in hourly_stat(df, medians=["abundance"]).collect()}
    assert out == {(ts("2024-01-01 10:00:00"), "p"): 10_000.0, (None, "p"): 2.0, (ts("2024-01-01 10:00:00"), None): 4.0,
                   (ts("2024-01-01 12:00:00"), "p"): 3.0}


def test_non_finite_values_and_missing_scopes_are_in_no_cell(spark):
    inf = float("inf")
    rows = [(1, float(i), float(i * i % 97), float(i % 11)) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "hour int, fsc_small double, D1 double, D2 double")
    bad = spark.createDataFrame([(1, inf, 1.0, 1.0), (1, 5.0, inf, None), (1, 6.0, -inf, float("nan")), (None, 5.0, 5.0, 5.0)], df.schema)
    key = lambda d: {(r.hour, r.panel, r.lattice, r.i, r.j): r.n
                     for r in hex_counts_panels(d, ["D1", "D2"], ["a", "b"], by=["hour"]).collect()}
    assert key(df.union(bad)) == key(df)
    long = lambda d: d.selectExpr("hour", "fsc_small", "stack(2, 'a', D1, 'b', D2) AS (panel, y_value)")
    assert {(r.hour, r.panel, r.lattice, r.i, r.j): r.n for r in hex_counts(long(df.union(bad)), by=["hour"]).collect()} == key(df)
    logs = lambda d: {(r.hour, r.ix, r.iy): r.n for r in log_bin_counts(d, "fsc_small", "D1", by=["hour"]).collect()}
    assert logs(df.union(bad)) == logs(df)


def test_shared_y_range(spark):
    df = spark.createDataFrame([(float(i), float(i), 1000.0 * i) for i in range(50)], "fsc_small double, D1 double, D2 double")
    n = {free: {p: 0 for p in "ab"} for free in (True, False)}
    for free in n:
        for r in hex_counts_panels(df, ["D1", "D2"], ["a", "b"], free_y=free).collect():
            n[free][r.panel] += 1
    assert n[True]["a"] == n[True]["b"] and n[False]["b"] == n[True]["b"]
    rows = hex_counts_panels(df, ["D1", "D2"], ["a", "b"], free_y=False).where("panel = 'a'").collect()
    assert {r.j for r in rows} == {0}


def test_centroids_skip_missing_values_and_keep_precision(spark):
    o = spark.createDataFrame([(1, "a", 1e-7, float("nan")), (1, "a", 3e-7, 3.0), (1, "a", None, None)], "gating_id int, pop string, x double, y double")
    r = gate_centroids(o).first()
    assert abs(r.x - 2e-7) < 1e-20 and r.y == 3.0


def test_decode_bins_with_gaps_and_cruises(spark):
    bins = spark.createDataFrame([("A", 1, 10.0), ("A", 3, 30.0), ("B", 1, -1.0)], "cruise string, idx long, pe double")
    g = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("A", 4), ("B", 1), ("C", 1), ("A", None)], "cruise string, pe_coord int")
    got = sorted(((r.cruise, r.pe) for r in decode_bins(g, bins, channels=["pe"], by=["cruise"]).collect()), key=str)
    assert got == sorted([("A", 10.0), ("A", None), ("A", 30.0), ("A", None), ("B", -1.0), ("C", None), ("A", None)], key=str)


def test_series_of_two_cruises_stay_apart(spark):
    df = spark.createDataFrame([("A", "p", 1, 2.0, 5.0), ("A", "p", 1, 1.0, 4.0), ("B", "p", 1, 1.0, 9.0)],
                               "cruise string, pop string, date int, x double, Qc_sum double")
    assert {r.cruise: (r.x, r.height) for r in series_arrays(df, "x", "Qc_sum", by=["cruise"]).collect()} == {
        "A": ([1.0, 2.0], [4.0, 5.0]), "B": ([1.0], [9.0])}


def test_ordered_puts_missing_times_last(spark):
    df = spark.createDataFrame([(None, 1), (2, 1), (1, 2), (1, 1)], "t int, k int")
    assert [tuple(r) for r in ordered(df, "t", "k").collect()] == [(1, 1), (1, 2), (2, 1), (None, 1)]


def test_hex_counts_without_panel_or_keys(spark):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(50)], "fsc_small double, y_value double")
    out = hex_counts(df, panel=None)
    assert out.agg(F.sum("n")).first()[0] == 50 and "panel" not in out.columns


def test_two_bins_for_one_position_are_an_error(spark):
    import pytest
    bins = spark.createDataFrame([(1, 0.5), (2, 1.5), (2, 1.7)], "idx int, pe double")
    g = spark.createDataFrame([(1,), (2,)], "pe_coord int")
    with pytest.raises(Exception, match="two grid bins for one position"):
        decode_bins(g, bins, channels=["pe"]).collect()
    far = spark.createDataFrame([(3, 9.0)], "idx int, pe double")
    assert sorted(((r.pe for r in decode_bins(g.union(spark.createDataFrame([(3,), (0,), (4,)], "pe_coord int")), far, channels=["pe"]).collect())), key=str) \
        == [9.0, None, None, None, None]
