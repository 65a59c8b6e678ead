"""Edge cases of the public API: validation errors, keys from file names, caps as columns."""

import datetime as dt
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cytotide.operators import guide_lines, to_intervals
from cytotide.sources import normalize_registry, read_gridded, read_registry, scan_parquet


def test_registry_validation(spark):
    with pytest.raises(FileNotFoundError):
        read_registry(spark, "/nonexistent/data_sets.csv")
    bad = spark.createDataFrame([("a", "/x")], "name string, dir string")
    with pytest.raises(ValueError, match="default"):
        normalize_registry(bad)


def test_cruise_from_file_names(spark):
    d = tempfile.mkdtemp(prefix="cyto-grid2-")
    for cruise in ("CR1", "CR2"):
        pq.write_table(pa.table({"date": pa.array([dt.datetime(2024, 1, 1, 5)], pa.timestamp("us")),
                                 "pop": ["a"], "n": [3]}), os.path.join(d, f"{cruise}.hourly_gridded.parquet"))
    g = read_gridded(spark, d)
    assert sorted(r.cruise for r in g.collect()) == ["CR1", "CR2"]
    s = scan_parquet(spark, d, columns=["n"], where="n > 1", with_cruise=True)
    assert sorted(s.columns) == ["cruise", "n"] and s.count() == 2


def test_intervals_cap_as_column_and_guide_tables(spark):
    plan = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1), (dt.datetime(2024, 1, 2), 2)],
                                 "start_date timestamp, filter_id long")
    iv = to_intervals(plan, tiebreak=["filter_id"], max_time=F.lit("2024-01-05 00:00:00").cast("timestamp"))
    assert {r.filter_id: r.end_date for r in iv.collect()}[2] == dt.datetime(2024, 1, 5)
    params = spark.createDataFrame(
        [(1, 1000.0, 10.0, None, 1.0, 0.0, 0.5, 1.0, 1.0, 0.0, 0.25, 11.0)],
        "filter_id long, beads_fsc_small double, beads_D1 double, beads_D2 double, notch_small_D1 double, "
        "offset_small_D1 double, notch_small_D2 double, offset_small_D2 double, notch_large_D1 double, "
        "offset_large_D1 double, notch_large_D2 double, offset_large_D2 double")
    g = guide_lines(params)
    assert set(g) == {"vline", "hline", "segment"}
    assert g["vline"].count() == 4 and g["hline"].count() == 1   # missing beads_D2 drops its line
    # Equal slopes -> one large segment from x_min; D2: lines cross at x = 40 -> two segments.
    seg = {(r.panel, r.line_kind): (r.x_start, r.x_end) for r in g["segment"].collect()}
    assert seg == {("D1 vs fsc_small", "large"): (0.0, 65536.0), ("D2 vs fsc_small", "small"): (0.0, 40.0),
                   ("D2 vs fsc_small", "large"): (40.0, 65536.0)}
