"""Filters and Column helpers, one test per trap where it applies."""

import datetime as dt
import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cruise_helpers import ts
from cytotide.functions import (clamp, equivalent_diameter, floor_hour, iso_text, nearly_equal,
                                nulls_for_nans, parse_time, unpivot_panels, untransform)
from cytotide.operators import (at_time, exclude_flags, in_hour, in_range, keep_pops, keep_quantile,
                                plottable, aligned, valid_segments)


def test_exclude_flags_keeps_null_and_prints_integers(spark):
    # A NULL flag is kept; double 1.0 prints as "1" (R's as.character).
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None), (4, 3.0), (5, 4.0)], "id int, flag double")
    kept = sorted(r.id for r in exclude_flags(df).collect())
    assert kept == [1, 3, 5]
    assert sorted(r.id for r in exclude_flags(df, flags=[]).collect()) == [1, 2, 3, 4, 5]


def test_keep_pops_and_quantile(spark):
    df = spark.createDataFrame([("a", "50"), ("b", "2.5"), (None, "50")], "pop string, quantile string")
    assert [r.pop for r in keep_pops(df, ["a", "b"]).collect()] == ["a", "b"]
    assert keep_quantile(df, 50).count() == 2


def test_time_selections(spark):
    df = spark.createDataFrame([(ts("2024-01-01 10:00:00"),), (ts("2024-01-01 10:59:59"),),
                                (ts("2024-01-01 11:00:00"),)], "time timestamp")
    assert in_hour(df, "2024-01-01 10:30:00").count() == 2
    assert in_hour(df, None).count() == 0
    assert at_time(df, "2024-01-01T11:00:00Z").count() == 1
    assert in_range(df, "2024-01-01 10:00:00", "2024-01-01 11:00:00").count() == 2
    # The hour predicate is a range, so it can reach the Parquet scan.
    plan = in_hour(df, "2024-01-01 10:30:00")._jdf.queryExecution().optimizedPlan().toString()
    assert "date_trunc" not in plan


def test_plottable_and_alignment(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 2.0), (float("nan"), 1.0), (None, 1.0)], "x double, y double")
    assert plottable(df, ["x", "y"], ["x"]).count() == 1
    a = spark.createDataFrame([(100.0, 150.0, 100.0), (100.0, 250.0, 100.0)], "D1 double, D2 double, width double")
    assert a.where(aligned()).count() == 1


def test_valid_segments(spark):
    df = spark.createDataFrame([(ts("2024-01-01 00:00:00"), ts("2024-01-02 00:00:00"), 1.0),
                                (ts("2024-01-01 00:00:00"), None, 1.0),
                                (ts("2024-01-01 00:00:00"), ts("2024-01-02 00:00:00"), None)],
                               "start_date timestamp, end_date timestamp, y_value double")
    assert valid_segments(df).count() == 1


def test_nan_to_null_T9(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, k int")
    assert [r.v for r in nulls_for_nans(df).orderBy("k").collect()] == [None, 2.0]


def test_parse_time_column_vs_row_T7(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:05",), ("2024-01-01 10:00",), ("junk",)], "t string")
    col = [r.t for r in parse_time(df, "t", mode="column").collect()]
    row = [r.t for r in parse_time(df, "t", mode="row").collect()]
    assert col[1] is None and row[1] == ts("2024-01-01 10:00:00")
    assert col[2] is None and row[2] is None
    only_hm = spark.createDataFrame([("2024-01-01 10:00",), ("2024-01-01 11:30",)], "t string")
    # No value has seconds: the minute-only fallback is used for the whole column.
    assert [r.t for r in parse_time(only_hm, "t").collect()] == [ts("2024-01-01 10:00:00"),
                                                                  ts("2024-01-01 11:30:00")]
    epoch = spark.createDataFrame([(3600,)], "t long")
    assert parse_time(epoch, "t").first().t == ts("1970-01-01 01:00:00")


def test_timestamp_ntz_is_utc_wall_time_T10(spark):
    df = spark.createDataFrame([(ts("2024-01-01 10:00:00"),)], T.StructType([T.StructField("t", T.TimestampNTZType())]))
    out = parse_time(df, "t")
    assert isinstance(out.schema["t"].dataType, T.TimestampType)
    assert out.select(iso_text("t").alias("s")).first().s == "2024-01-01T10:00:00Z"


def test_floor_hour_and_iso(spark):
    df = spark.createDataFrame([(ts("2024-01-01 10:42:13"),), (None,)], "t timestamp")
    rows = df.select(floor_hour("t").alias("h"), iso_text("t").alias("s")).collect()
    assert rows[0].h == ts("2024-01-01 10:00:00") and rows[0].s == "2024-01-01T10:42:13Z"
    assert rows[1].s is None


def test_equivalent_diameter(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "qc double")
    got = [r.d for r in df.select(equivalent_diameter("qc").alias("d")).collect()]
    expect = round(2 * (3 / (4 * math.pi) * (1 / 0.261) ** (1 / 0.86)) ** (1 / 3), 5)
    assert got[0] == 0.0 and abs(got[1] - expect) < 1e-9 and math.isnan(got[2])


def test_clamp_and_nearly_equal(spark):
    df = spark.createDataFrame([(5.0, 0.0, 3.0), (-1.0, 0.0, 3.0), (None, 0.0, 3.0)], "v double, lo double, hi double")
    assert [r.c for r in df.select(clamp("v", "lo", "hi").alias("c")).collect()] == [3.0, 0.0, None]
    e = spark.createDataFrame([(1.0, 1.0 + 1e-9), (1.0, 1.001), (0.0, 1e-9)], "a double, b double")
    assert [r.e for r in e.select(nearly_equal("a", "b").alias("e")).collect()] == [True, False, True]


def test_unpivot_and_untransform(spark):
    df = spark.createDataFrame([(1.0, 10.0, None, 3.0, 4.0)], "fsc_small double, chl_small double, pe double, D1 double, D2 double")
    long = unpivot_panels(df)
    assert sorted(r.y_var for r in long.collect()) == ["D1", "D2", "chl_small"]
    u = untransform(spark.createDataFrame([(10 ** 3.5, 0.0)], "fsc_small double, pe double"), ["fsc_small", "pe"]).first()
    assert abs(u.fsc_small - 65536.0) < 1e-6 and u.pe is None


def test_time_texts_in_many_shapes(spark):
    from cytotide.functions.time import parse_text
    at = dt.datetime(2024, 1, 5, 10, 15, 30)
    hms = {"2024-01-05 10:15:30": at, "2024/1/5T10.15.30Z": at, "20240105101530": at, "20240105 101530": at, "  24.01.05 10-15-30 ": at,
           "20240105T10:15:30.25": at.replace(microsecond=250000), "2024-Jan-05 10:15:30 PM": at.replace(hour=22), "2024 January 5, 10:15:30": at,
           "2024-01-05 12:15:30 am": at.replace(hour=0), "2024-01-05 12:15:30 p.m.": at.replace(hour=12), "2024-01-05 10:15:30-0700": at.replace(hour=17),
           "2024-01-05 10:15:30 +05:30": at.replace(hour=4, minute=45), "2024-01-05 10h15m30s": at, "2024年1月5日 10:15:30": at,
           "2024-01-05 10:15:30,5": at.replace(microsecond=500000), "2024-01-05 24:00:00": dt.datetime(2024, 1, 6), "69-01-05 10:15:30": at.replace(year=1969),
           "68-01-05 10:15:30": at.replace(year=2068), "2024-02-30 10:15:30": None, "2024-01-05 25:15:30": None, "2024-01-05 13:15:30 pm": None,
           "2024-13-05 10:15:30": None, "05.01.2024 10:15:30": None, "2024-01-05": None, "junk": None, "": None, None: None, "2024-01-05 10:15": None}
    hm = {"2024-01-05 10:15": at.replace(second=0), "202401051015": at.replace(second=0), "2024-jan-5 10h15m": at.replace(second=0),
          "2024-01-05 10:15 pm": at.replace(hour=22, second=0), "2024/01/05T10:15+01": at.replace(hour=9, second=0), "2024-01-05 10:15:30": None,
          "2024-Jan-05 10:15:30": None, "20240105101530": None}
    for want, seconds in ((hms, True), (hm, False)):
        df = spark.createDataFrame([(k,) for k in want], "t string")
        got = {r.t: r.at for r in df.select("t", parse_text(F.col("t"), seconds).alias("at")).collect()}
        assert got == want
