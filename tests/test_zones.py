"""Zone maps of Parquet files: extents without reading rows, windows that open only their files, VCT hours by name."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cytotide.sources import may_hold, read_vct, read_window, zone_map, zone_range

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A file an hour; the fifth without statistics, the sixth lacks a column, the last is empty."""
    d = tmp_path_factory.mktemp("hours")
    for h in range(8):
        n = 0 if h == 7 else 50
        t = {"time": pa.array([BASE + dt.timedelta(hours=h, minutes=m) for m in range(n)], pa.timestamp("us", tz="UTC")),
             "D1": pa.array([float(h * 100 + m) if m % 7 else None for m in range(n)], pa.float64()),
             "pe": pa.array([float("nan") if m % 5 == 0 else float(-m * h) for m in range(n)], pa.float64()),
             "n": pa.array([h * m for m in range(n)], pa.int64()), "pop": [f"p{h}" for _ in range(n)]}
        if h == 5:
            del t["n"]
        pq.write_table(pa.table(t), os.path.join(d, f"h{h}.parquet"), write_statistics=h != 4, row_group_size=20)
    return str(d)


SCHEMA = "time timestamp, D1 double, pe double, n bigint, pop string"


def test_zone_map_tells_what_footers_tell(spark, files):
    from pyspark.sql.types import _parse_datatype_string
    zones = zone_map(spark, files, ["time", "D1", "pe", "n", "pop"], _parse_datatype_string(SCHEMA))
    got = {os.path.basename(r.path): r for r in zones.collect()}
    assert len(got) == 8 and got["h2.parquet"].rows == 50 and got["h2.parquet"].D1_nulls == 8
    assert (got["h2.parquet"].D1_min, got["h2.parquet"].D1_max, got["h2.parquet"].pop_min) == (201.0, 248.0, "p2")
    assert not got["h4.parquet"].D1_known and got["h4.parquet"].D1_min is None
    assert got["h5.parquet"].n_known and got["h5.parquet"].n_nulls == 50 and got["h5.parquet"].n_min is None
    assert got["h7.parquet"].rows == 0 and got["h7.parquet"].time_known and got["h7.parquet"].time_min is None


def test_extents_equal_a_scan(spark, files):
    from pyspark.sql.types import _parse_datatype_string
    zones = zone_map(spark, files, ["time", "D1", "pe", "n"], _parse_datatype_string(SCHEMA))
    got = zone_range(spark, zones, ["time", "D1", "pe", "n"]).first()
    df = spark.read.schema(SCHEMA).parquet(files)
    pe = F.when(~F.isnan("pe"), F.col("pe"))
    want = df.agg(F.min("time"), F.max("time"), F.min("D1"), F.max("D1"), F.min(pe), F.max(pe), F.min("n"), F.max("n")).first()
    assert tuple(got) == tuple(want)
    told = zones.where("D1_known and pe_known and n_known and time_known")
    plan = zone_range(spark, told, ["time", "D1"])._jdf.queryExecution().toString()
    assert "FileScan parquet" not in plan  # no row group is read where footers tell


def test_windows_open_only_their_files(spark, files):
    from pyspark.sql.types import _parse_datatype_string
    zones = zone_map(spark, files, ["time", "D1"], _parse_datatype_string(SCHEMA))
    everything = spark.read.schema(SCHEMA).parquet(files)
    for column, lo, hi, opened in [("time", BASE + dt.timedelta(hours=2, minutes=10), BASE + dt.timedelta(hours=3), {2, 4}),
                                   ("time", BASE + dt.timedelta(hours=6), None, {4, 6}), ("D1", None, 105.0, {0, 1, 4}), ("D1", 640.0, 640.5, {4, 6}),
                                   ("time", BASE - dt.timedelta(days=2), BASE, {4})]:
        df = read_window(spark, zones, column, lo, hi)
        assert {int(os.path.basename(p)[1]) for p in df.inputFiles()} == opened
        want = everything.where((F.col(column) >= F.lit(lo) if lo is not None else F.lit(True)) & (F.col(column) < F.lit(hi) if hi is not None else F.lit(True)))
        assert df.select("time", "D1").exceptAll(want.select("time", "D1")).count() == 0 and df.count() == want.count()
    assert read_window(spark, zones.where(F.col("D1_known")), "D1", 1e9).count() == 0
    assert zones.where(may_hold("D1", 0.0)).count() < 9 and zone_map(spark, files, ["D1"]).where(may_hold("D1")).count() == 8


def test_vct_hours_between(spark, tmp_path):
    folder = tmp_path / "CR1_vct"
    folder.mkdir()
    for h in range(6):
        t = pa.table({"date": pa.array([dt.datetime(2024, 1, 1, h, m) for m in (0, 20, 40)], pa.timestamp("us")), "q50": [True] * 3, "pop_q50": ["x"] * 3,
                      **{c: [1.0] * 3 for c in ("D1", "D2", "fsc_small", "chl_small", "pe", "diam_mid_q50", "Qc_mid_q50", "filter_id", "gating_id")}})
        pq.write_table(t, folder / f"2024-01-01T{h:02d}-00-00+00-00.1H.vct.parquet")
    (folder / "2024-01-01T05-00-00+00-00.1H.vct.parquet").write_bytes(b"no Parquet: opening it would fail")
    some = read_vct(spark, str(folder), between=("2024-01-01T01:30:00Z", "2024-01-01T03:20:00Z"))
    assert sorted((r.time.hour, r.time.minute) for r in some.collect()) == [(1, 40), (2, 0), (2, 20), (2, 40), (3, 0)]
    assert read_vct(spark, str(folder), between=("2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z")).count() == 0


def test_listing_has_empty_folders_and_warns_of_missing_ones(spark, tmp_path):
    from cytotide.sources import build_catalog, list_files
    from cytotide.sources.listing import list_tree
    root = tmp_path / "set"
    for d in ("CR1_vct", "deep/CR2_vct", "deep/down/CR3_vct", "grid", "x/grid/y"):
        (root / d).mkdir(parents=True)
    for f in ("CR1.outlier.db", "CR1_vct/2024-01-01T00-00-00+00-00.vct.parquet", "deep/CR2.beads-sample-10.parquet", "x/grid/y/CR1.grid_bins.parquet",
              "x/CR9.hourly_gridded.parquet", "x/grid/CR1.hourly_gridded.parquet", "notes_vct.txt"):
        (root / f).write_text("x")
    (tmp_path / "empty").mkdir()
    tree = {(os.path.relpath(r.path, root), r.is_dir) for r in list_tree(spark, str(root)).collect()}
    want = {(os.path.relpath(os.path.join(d, n), root), n in dirs) for d, dirs, names in os.walk(root) for n in [*dirs, *names]}
    assert tree == want
    registry = spark.createDataFrame([("a", str(root), True), ("b", f"file:{root}", False), ("c", str(tmp_path / "empty"), False),
                                      ("d", str(tmp_path / "gone"), False), ("e", None, False)], "name string, dir string, default boolean")
    with pytest.warns(UserWarning, match="gone"):
        files = list_files(spark, registry)
    got = {(r.name, r.cruise): (r.outlier_db, r.bead_file, r.vct_dir, r.grid_file, r.gridded_file) for r in build_catalog(files).collect()}
    one = {"CR1": (f"{root}/CR1.outlier.db", None, f"{root}/CR1_vct", f"{root}/x/grid/y/CR1.grid_bins.parquet", f"{root}/x/grid/CR1.hourly_gridded.parquet"),
           "CR2": (None, f"{root}/deep/CR2.beads-sample-10.parquet", f"{root}/deep/CR2_vct", None, None),
           "CR3": (None, None, f"{root}/deep/down/CR3_vct", None, None)}
    assert got == {(n, c): v for n in "ab" for c, v in one.items()}
