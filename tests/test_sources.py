"""Sources on fixtures written to temporary folders: SQLite cruise database, VCT
directory, registry CSV and a data-set folder tree (S1 S2 S7-S12 D1 J3 O2; T2)."""

import datetime as dt
import os
import sqlite3
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cytotide.sources import (ambiguous_vct_hours, assert_unique, build_catalog, default_variation,
                              grid_bins, list_files, read_registry, read_sqlite, read_vct, scan_parquet,
                              stat_series, vct_files)


def test_sqlite_source_partitions(spark):
    d = tempfile.mkdtemp(prefix="cyto-sqlite-")
    db = os.path.join(d, "CR1.outlier.db")
    con = sqlite3.connect(db)
    con.execute("CREATE TABLE stat (time TEXT, pop TEXT, quantile REAL, opp_evt_ratio REAL, n_count INTEGER, "
                "abundance REAL, fsc_med REAL, chl_med REAL, pe_med REAL, diam_mid_med REAL, flag INTEGER)")
    rows = [(f"2024-01-01T00:{m:02d}:00Z", "p", q, 0.1, m, 1.0, 2.0, 3.0, 4.0, 5.0, m % 3)
            for m in range(0, 60, 3) for q in (2.5, 50.0, 97.5)]
    con.executemany("INSERT INTO stat VALUES (?,?,?,?,?,?,?,?,?,?,?)", rows)
    con.commit()
    con.close()
    df = read_sqlite(spark, db, "stat")
    assert df.count() == len(rows) and df.first().cruise == "CR1"
    part = read_sqlite(spark, db, "stat", columns=["pop", "n_count"], where="quantile = 50 AND n_count > 30")
    assert part.columns == ["pop", "n_count", "cruise"] and part.count() == 9
    other = os.path.join(d, "CR2.outlier.db")
    con = sqlite3.connect(other)
    con.execute("CREATE TABLE stat (time TEXT, pop TEXT, quantile REAL, opp_evt_ratio REAL, n_count INTEGER, "
                "abundance REAL, fsc_med REAL, chl_med REAL, pe_med REAL, diam_mid_med REAL, flag INTEGER)")
    con.execute("INSERT INTO stat (time, pop, n_count, flag, quantile) VALUES ('x', 5, 'many', 1.5, '7')")
    con.commit()
    con.close()
    both = read_sqlite(spark, [db, other], "stat")
    assert {r["cruise"]: r["count"] for r in both.groupBy("cruise").count().collect()} == {"CR1": len(rows), "CR2": 1}
    odd = both.where("cruise = 'CR2'").first()
    assert (odd.pop, odd.n_count, odd.flag, odd["quantile"]) == ("5", None, 1, 7.0)
    with pytest.raises(Exception, match="lacks columns"):
        read_sqlite(spark, db, "stat", columns=["nope"])
    st = stat_series(df)
    assert st.count() == 20 and st.schema["time"].dataType.typeName() == "timestamp"


def test_vct_directory_and_file_hours(spark):
    d = tempfile.mkdtemp(prefix="cyto-vct-")
    vdir = os.path.join(d, "CR1_vct")
    os.makedirs(vdir)
    names = ["2024-01-01T10-00-00+00-00.1H.vct.parquet", "2024-01-01T04-00-00-07-00.1H.vct.parquet",
             "2024-01-01T12-00-00+00-00.1H.vct.parquet", "notes.txt"]
    for i, n in enumerate(names):
        if n.endswith(".txt"):
            open(os.path.join(vdir, n), "w").write("x")
            continue
        t = pa.table({"date": pa.array([dt.datetime(2024, 1, 1, 10 + i % 3)] * 2, pa.timestamp("us")),
                      "q50": [True, False], "pop_q50": ["prochloro", "synecho"], "D1": [1.0, 2.0],
                      "D2": [1.0, 2.0], "fsc_small": [1.0, 2.0], "chl_small": [1.0, 2.0], "pe": [1.0, 2.0],
                      "diam_mid_q50": [1.0, 2.0], "Qc_mid_q50": [1.0, 2.0], "filter_id": [1.0, 1.0],
                      "gating_id": [2.0, 2.0]})
        pq.write_table(t, os.path.join(vdir, n))
    all_hours = read_vct(spark, vdir)
    assert all_hours.count() == 3 and set(all_hours.columns) >= {"time", "pop", "diameter", "qc", "file_hour"}
    # -07:00 at 04:00 local is 11:00Z; two files name the 10:00Z and 11:00Z hours.
    one = read_vct(spark, vdir, at="2024-01-01T11:30:00Z")
    assert one.count() == 1 and one.first().cruise == "CR1"
    assert read_vct(spark, vdir, at="2024-01-01T15:00:00Z").count() == 0
    assert ambiguous_vct_hours(vct_files(spark, vdir)).count() == 0
    missing = os.path.join(d, "missing_vct")
    for _ in range(2):  # the typed empty frame is the same every time, and has the columns of a full one
        empty = read_vct(spark, missing)
        assert empty.count() == 0 and empty.columns == all_hours.columns
    assert read_vct(spark, [vdir, missing]).count() == 3  # a missing folder takes nothing from the others
    pq.write_table(t, os.path.join(vdir, "2024-01-01T11-00-00+00-00.again.vct.parquet"))
    with pytest.raises(ValueError, match="more than one VCT file"):
        read_vct(spark, vdir, at="2024-01-01T11:30:00Z")
    open(os.path.join(vdir, "2024-01-01T13-00-00+00-00.bad.vct.parquet"), "w").write("not parquet")
    with pytest.raises(Exception):
        read_vct(spark, vdir).count()


def test_registry_and_catalog_tree(spark):
    root = tempfile.mkdtemp(prefix="cyto-tree-")
    sets = {"v1": True, "v2": False, "v3": False}
    for name in sets:
        os.makedirs(os.path.join(root, name, "grid"))
    touch = [("v1", "CR1.outlier.db"), ("v1", "CR1.beads-sample-2024.parquet"), ("v1", "CR1_vct/a.vct.parquet"),
             ("v1", "grid/CR1.grid_bins.parquet"), ("v1", "grid/CR1.hourly_gridded.parquet"),
             ("v2", "CR1.outlier.db"), ("v2", "CR2.outlier.db"), ("v3", "grid/CR1.grid_bins.parquet")]
    for name, rel in touch:
        p = os.path.join(root, name, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        open(p, "w").write("x")
    csv = os.path.join(root, "data_sets.csv")
    with open(csv, "w") as f:
        f.write("name,dir,default\n")
        for name, default in sets.items():
            f.write(f"{name},{os.path.join(root, name)},{'TRUE' if default else 'no'}\n")
    reg = read_registry(spark, csv)
    assert {r.name: r.default for r in reg.collect()} == sets
    files = list_files(spark, reg)
    assert_unique(files)
    cat = {(r.name, r.cruise): r for r in build_catalog(files).collect()}
    assert set(cat) == {("v1", "CR1"), ("v2", "CR1"), ("v2", "CR2")}  # v3 has grid files only (T2)
    assert cat[("v1", "CR1")].vct_dir.endswith("CR1_vct") and cat[("v2", "CR1")].grid_file is None
    dv = {r.cruise: r.variation for r in default_variation(build_catalog(files), reg).collect()}
    assert dv == {"CR1": "v1", "CR2": "v2"}
    os.makedirs(os.path.join(root, "v2", "x"))
    open(os.path.join(root, "v2", "x", "CR1.outlier.db"), "w").write("x")
    with pytest.raises(ValueError, match="duplicates"):
        assert_unique(list_files(spark, reg))
    with pytest.raises(Exception, match="at most one outlier_db.*CR1"):
        build_catalog(list_files(spark, reg)).collect()


def test_folders_above_a_data_set_are_no_cruise(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="cyto-root-"), "d_vct")
    os.makedirs(os.path.join(root, "CR1_vct"))
    open(os.path.join(root, "CR1_vct", "a.vct.parquet"), "w").write("x")
    reg = spark.createDataFrame([("s", root, True), ("u", "file://" + root + "/", False), ("none", root + "/absent", False)],
                                "name string, dir string, default boolean")
    assert sorted((r.name, r.kind, r.cruise) for r in list_files(spark, reg).collect()) == [("s", "vct_dir", "CR1"), ("u", "vct_dir", "CR1")]


def test_grid_bins_row_position_and_scan(spark):
    d = tempfile.mkdtemp(prefix="cyto-grid-")
    p = os.path.join(d, "CR9.grid_bins.parquet")
    pq.write_table(pa.table({"fsc_small": [1.0, 2.0, 3.0], "chl_small": [1.0, 2.0, 3.0],
                             "pe": [1.0, 2.0, 3.0], "Qc": [0.1, 0.2, 0.3]}), p)
    b = grid_bins(spark, p)
    assert sorted((r.idx, r.fsc_small) for r in b.collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert b.first().cruise == "CR9"
    s = scan_parquet(spark, p, columns=["pe"], where="fsc_small > 1")
    assert s.columns == ["pe"] and s.count() == 2
    assert "PushedFilters: [IsNotNull(fsc_small), GreaterThan(fsc_small,1.0)]" in \
        s._jdf.queryExecution().executedPlan().toString()


def _scan_files_read(df):
    """Number of files the Parquet scan opened in the DataFrame's own execution."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    try:
        plan = plan.finalPhysicalPlan()
    except Exception:  # noqa: BLE001
        pass
    total, stack = 0, [plan]
    while stack:
        n = stack.pop()
        m = n.metrics()
        if n.nodeName().startswith("Scan") and m.contains("numFiles"):
            total += m.get("numFiles").get().value()
        it = n.children().iterator()
        while it.hasNext():
            stack.append(it.next())
    return total


def test_vct_hour_selection_prunes_files(spark):
    d = tempfile.mkdtemp(prefix="cyto-vct-prune-")
    vdir = os.path.join(d, "CR7_vct")
    os.makedirs(vdir)
    for h in range(6):
        t = pa.table({"date": pa.array([dt.datetime(2024, 1, 1, h)] * 3, pa.timestamp("us")), "q50": [True] * 3,
                      "pop_q50": ["beads"] * 3, "D1": [1.0] * 3, "D2": [1.0] * 3, "fsc_small": [1.0] * 3,
                      "chl_small": [1.0] * 3, "pe": [1.0] * 3, "diam_mid_q50": [1.0] * 3,
                      "Qc_mid_q50": [1.0] * 3, "filter_id": [1.0] * 3, "gating_id": [1.0] * 3})
        pq.write_table(t, os.path.join(vdir, f"2024-01-01T{h:02d}-00-00+00-00.1H.vct.parquet"))
    one = read_vct(spark, vdir, at="2024-01-01T03:10:00Z")
    assert _scan_files_read(one) == 1
    assert {r.time for r in one.collect()} == {dt.datetime(2024, 1, 1, 3)}


def test_sfl_text_time_meets_stat_timestamps_T11(spark):
    from cytotide.operators import sfl_only_count
    from cytotide.sources import sfl_series
    cols = "date string, lat string, lon string, conductivity double, salinity double, ocean_tmp double, " \
           "par double, stream_pressure double, event_rate double, flag int"
    sfl = spark.createDataFrame([("2024-01-01T00:00:00Z", "1", "2", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0),
                                 ("2024-01-01T00:03:00Z", "x", "2", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0)], cols)
    stat = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0),)], "time timestamp")
    s = sfl_series(sfl)
    assert s.schema["time"].dataType.typeName() == "timestamp"
    assert [r.lat for r in s.orderBy("time").collect()] == [1.0, None]
    assert sfl_only_count(s, stat).first().n == 1


def test_sfl_with_outlier_flags(spark):
    from cytotide.sources import read_sfl_with_flags, sfl_series
    d = tempfile.mkdtemp(prefix="cyto-sfl-")
    db = os.path.join(d, "CR3.outlier.db")
    con = sqlite3.connect(db)
    con.execute("CREATE TABLE sfl (file_id TEXT, date TEXT, lat TEXT, lon TEXT, conductivity REAL, salinity REAL, "
                "ocean_tmp REAL, par REAL, stream_pressure REAL, event_rate REAL)")
    con.execute("CREATE TABLE outlier (file_id TEXT, flag INTEGER)")
    con.executemany("INSERT INTO sfl VALUES (?,?,?,?,?,?,?,?,?,?)",
                    [(f"f{i}", f"2024-01-01T00:{3 * i:02d}:00Z", "21.5", "-158.0", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
                     for i in range(5)])
    con.executemany("INSERT INTO outlier VALUES (?,?)", [("f0", 0), ("f1", 1), ("f2", 2)])
    con.commit()
    con.close()
    s = sfl_series(read_sfl_with_flags(spark, db), by=["cruise"])
    flags = {r.time.minute: r.flag for r in s.collect()}
    assert flags == {0: 0, 3: 1, 6: 2, 9: None, 12: None}   # files without an outlier row keep a NULL flag
    assert {r.cruise for r in s.collect()} == {"CR3"}
