"""SQLite source: Spark's filters in the database, files picked by cruise, files of different columns."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import (EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull, LessThan, Not,
                                    StringContains, StringEndsWith, StringStartsWith)

from cytotide.sources import merged_parquet, read_sqlite, widened
from cytotide.sources.sqlite import SQLiteDataSource, _SQLiteReader


@pytest.fixture(scope="module")
def databases(tmp_path_factory):
    d = tmp_path_factory.mktemp("dbs")
    tables = {
        "A": ("time TEXT, pop TEXT, quantile REAL, n INTEGER, flag BOOLEAN",
              [(f"2024-01-01T{h:02d}:00:00Z", p, q, h * 10, h % 2) for h in range(24) for p in ("x", "Y", None) for q in (2.5, 50.0)]),
        # other columns, other types, and values that aren't stored as declared
        "B": ("time TEXT, QUANTILE INTEGER, n REAL, extra TEXT",
              [("2024-01-01T05:00:00Z", 50, 1.5, "more"), (7, "50", "many", None), ("2024-01-02", None, None, "it's"), (None, 2.5, 50, "")]),
    }
    out = []
    for name, (ddl, rows) in tables.items():
        out.append(os.path.join(d, f"{name}.outlier.db"))
        con = sqlite3.connect(out[-1])
        con.execute(f"CREATE TABLE stat ({ddl})")
        con.executemany(f"INSERT INTO stat VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.commit()
        con.close()
    return out


def reader(paths, columns=None):
    import json
    options = {"paths": json.dumps(paths), "table": "stat"}
    from pyspark.sql.types import StructType, _parse_datatype_string  # noqa: F401
    schema = _parse_datatype_string(SQLiteDataSource(options).schema())
    return _SQLiteReader(options, schema)


def rows_read(r):
    return sum(b.num_rows for p in r.partitions() for b in r.read(p))


def test_schema_is_the_union(spark, databases):
    df = read_sqlite(spark, databases, "stat")
    assert dict(df.dtypes) == {"time": "string", "pop": "string", "quantile": "double", "n": "double", "flag": "boolean",
                               "extra": "string", "cruise": "string"}
    b = {r.extra: (r.time, r["quantile"], r.n, r.pop, r.flag) for r in df.where("cruise = 'B'").collect()}
    assert b == {"more": ("2024-01-01T05:00:00Z", 50.0, 1.5, None, None), None: ("7", 50.0, None, None, None),
                 "it's": ("2024-01-02", None, None, None, None), "": (None, 2.5, 50.0, None, None)}
    assert df.where("cruise = 'A' and extra is null").count() == 144


CONDITIONS = ["quantile = 50", "quantile <> 50", "n > 100 AND n <= 200", "time >= '2024-01-01T20'", "time < '3'", "pop = 'y' OR n = 10", "pop = 'Y'",
              "pop IS NULL", "pop IS NOT NULL", "n IS NULL", "time IS NULL", "pop IN ('x', 'z')", "pop NOT IN ('x')", "n IN (10, 1.5)",
              "quantile <=> 50", "extra LIKE 'it%'", "extra LIKE '%re'", "time LIKE '%T05%'", "cruise = 'B'", "cruise <> 'B' AND n = 0",
              "cruise IN ('A', 'C')", "cruise = 'C'", "cruise LIKE 'B%' AND n IS NOT NULL", "cruise IS NULL", "flag", "NOT flag", "n < double('NaN')",
              "n = double('NaN')", "extra = \"it's\"", "time = '7'", "extra IS NULL AND quantile = 2.5"]


@pytest.mark.parametrize("where", CONDITIONS)
def test_filters_return_what_spark_alone_returns(spark, databases, where):
    df = read_sqlite(spark, databases, "stat")
    plain = spark.createDataFrame(df.collect(), df.schema)
    assert sorted(map(str, df.where(where).collect())) == sorted(map(str, plain.where(where).collect()))


def test_filters_reach_the_select(databases):
    everything = rows_read(reader(databases))
    for f, most in [(EqualTo(("quantile",), 50.0), 76), (GreaterThan(("n",), 200.0), 144), (IsNull(("pop",)), 52), (In(("pop",), ("x",)), 48),
                    (Not(In(("pop",), ("x",))), 48), (StringStartsWith(("time",), "2024-01-01T05"), 8), (StringEndsWith(("time",), "23:00:00Z"), 7),
                    (StringContains(("time",), "T05"), 8), (EqualNullSafe(("pop",), "Y"), 48), (LessThan(("time",), "2024-01-01T02"), 13),
                    (GreaterThanOrEqual(("time",), "2024-01-01T22"), 14), (IsNotNull(("extra",)), 3)]:
        r = reader(databases)
        assert list(r.pushFilters([f])) == [f]  # Spark checks it again
        sql, values = r.statement(["time"])
        assert "WHERE" in sql.split(")", 1)[1] and rows_read(r) <= most < everything + 1, f
    r = reader(databases[:1])
    list(r.pushFilters([EqualTo(("quantile",), 50.0), GreaterThanOrEqual(("time",), "2024-01-01T20")]))
    assert rows_read(r) == 12


def test_cruise_predicates_skip_files(databases, monkeypatch):
    opened = []
    real = sqlite3.connect
    monkeypatch.setattr(sqlite3, "connect", lambda path, **k: (opened.append(path), real(path, **k))[1])
    for f, want in [(EqualTo(("cruise",), "B"), 1), (Not(EqualTo(("cruise",), "B")), 1), (In(("cruise",), ("B", "Z")), 1), (EqualTo(("cruise",), "Z"), 0),
                    (StringStartsWith(("cruise",), "A"), 1)]:
        r = reader(databases)
        opened.clear()
        assert list(r.pushFilters([f])) == []  # settled
        rows_read(r)
        assert len({p for p in opened}) == want, f
    r = reader(databases)
    odd = GreaterThan(("cruise",), "A")
    assert list(r.pushFilters([odd])) == [odd] and len(r.paths) == 2


def test_missing_tables_and_columns_are_named(spark, databases):
    with pytest.raises(Exception, match="not found"):
        read_sqlite(spark, databases, "sfl")
    with pytest.raises(Exception, match="lacks columns"):
        read_sqlite(spark, databases, "stat", columns=["nope"])
    assert read_sqlite(spark, databases, "stat", columns=["extra", "n"], where="n >= 50 OR extra = 'more'").where("cruise = 'B'").count() == 3


def test_widened_types():
    pairs = {("int", "bigint"): "bigint", ("bigint", "double"): "double", ("int", "float"): "double", ("bigint", "string"): "string",
             ("date", "timestamp"): "timestamp", ("date", "timestamp_ntz"): "timestamp", ("boolean", "int"): "string", ("void", "int"): "int"}
    assert all(widened(*p) == t and widened(*p[::-1]) == t for p, t in pairs.items())


def test_parquet_files_of_different_columns(spark, tmp_path):
    spark.range(3).select(F.col("id").cast("int").alias("n"), F.lit("a").alias("pop")).write.parquet(f"{tmp_path}/1")
    spark.range(2).select((F.col("id") + 0.5).alias("n"), F.lit(True).alias("q50"), F.lit(7).alias("pop")).write.parquet(f"{tmp_path}/2")
    df = merged_parquet(spark, [f"{tmp_path}/1", f"{tmp_path}/2"])
    assert dict(df.dtypes) == {"n": "double", "pop": "string", "q50": "boolean"}
    assert sorted((r.n, r.pop, r.q50) for r in df.collect()) == [(0.0, "a", None), (0.5, "7", True), (1.0, "a", None), (1.5, "7", True), (2.0, "a", None)]
    assert "PushedFilters: [" in df.where("n > 1")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_writer_task_that_runs_again_leaves_the_same_files(tmp_path):
    import pyarrow as pa

    from workload.q_sqlite import _writer
    rows = [(1, 0, "filter_plan", ["2024-01-01 00:00:00", "3"]), (1, 0, "filter_plan", ["2024-01-02 00:00:00", None]), (1, 0, "outlier", ["f1", "0"]),
            (2, 1, "outlier", ["f2", "1"])]
    kind = pa.schema([("no", pa.int64()), ("part", pa.int64()), ("table", pa.string()), ("v", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in some], schema=kind) for some in (rows[:1], rows[1:])]
    for _ in range(2):
        told = [p for b in _writer(str(tmp_path), False)(iter(batches)) for p in b.column(0).to_pylist()]
        assert told == [f"{tmp_path}/C1.0.outlier.db", f"{tmp_path}/C2.1.outlier.db"]
    broken = _writer(str(tmp_path), False)(iter([batches[0], None]))  # a task that fails midway leaves no file of that name changed
    with pytest.raises(Exception):
        list(broken)
    con = sqlite3.connect(f"{tmp_path}/C1.0.outlier.db")
    assert con.execute("SELECT * FROM filter_plan ORDER BY 1").fetchall() == [("2024-01-01 00:00:00", 3), ("2024-01-02 00:00:00", None)]
    assert con.execute("SELECT * FROM outlier").fetchall() == [("f1", 0)]
    assert sorted(n for n in os.listdir(tmp_path) if n.endswith(".db")) == ["C1.0.outlier.db", "C2.1.outlier.db"]


def test_database_writer_keeps_rows_across_batches_and_tables(tmp_path, monkeypatch):
    """Whole (cruise, part)s and tables, cut anywhere by batches, with nulls; written without a rollback journal."""
    import sqlite3

    import pyarrow as pa

    from workload import q_sqlite
    said, connect = [], sqlite3.connect

    def traced(*a, **k):
        con = connect(*a, **k)
        con.set_trace_callback(said.append)
        return con

    rows = [(no, 0, table, [None if (i + j) % 4 == 0 else f"{i}.{j}" for j in range(len(q_sqlite._COLUMNS[table]))])
            for no in (1, 2) for table in ("outlier", "stat") for i in range(5)]
    kind = pa.schema([("no", pa.int64()), ("part", pa.int64()), ("table", pa.string()), ("v", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows[a:a + 7]], schema=kind) for a in range(0, len(rows), 7)]
    monkeypatch.setattr(sqlite3, "connect", traced)
    done = [p for b in q_sqlite._writer(str(tmp_path), True)(iter(batches)) for p in b.column(0).to_pylist()]
    monkeypatch.undo()
    assert done == [f"{tmp_path}/C{no}.0.outlier.db" for no in (1, 2)] and sorted(map(str, tmp_path.iterdir())) == done
    for no, path in zip((1, 2), done):
        con = sqlite3.connect(path)
        for table in ("outlier", "stat"):
            left = [i for i, c in enumerate(q_sqlite._COLUMNS[table]) if no == 2 or c not in q_sqlite._NEW]
            got = con.execute(f"SELECT {', '.join(f'CAST({q_sqlite._COLUMNS[table][i]} AS TEXT)' for i in left)} FROM {table} ORDER BY rowid").fetchall()
            want = [tuple(v[i] for i in left) for n, _, t, v in rows if (n, t) == (no, table)]
            assert [[None if x is None else float(x) for x in r] for r in got] == [[None if x is None else float(x) for x in r] for r in want]
        con.close()
    assert sum("journal_mode = OFF" in x for x in said) == 2
