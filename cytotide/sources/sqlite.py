"""SQLite cruise databases as a partitioned Spark source.

A cruise database holds the SFL, outlier, Stat, filter, filter-plan,
gating, polygon and gating-plan tables. The JDBC driver is not on the
classpath, so this is a Python ``DataSource``: the driver reads the table's
column list and each file's rowid bounds, and each task reads one rowid range
of one file with the standard-library ``sqlite3`` module. SQLite opens files,
not streams: the databases must lie on a mount that the driver and every
executor see.

Files may have different columns: the schema is their union, types widened
(``sources.merge``), and a column that a file lacks is NULL there.

Columns go into the SELECT, and so do Spark's own filters (``pushFilters``).
SQLite stores what it is given, whatever a column's declared type, so a value of
another storage class than declared passes the database's filter and Spark
decides on it. Predicates on the cruise are decided on file names: other files
aren't opened.

Usage::

    stat = read_sqlite(spark, ["/cruises/A.outlier.db", "/cruises/B.outlier.db"], "stat")
    stat.where("cruise = 'A' AND quantile = 50 AND time >= '2024-01-01'").select("time", "pop")
"""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains,
                                    StringEndsWith, StringStartsWith)

from cytotide.sources.merge import widened

FORMAT = "cytotide_sqlite"
PUSH_CONF = "spark.sql.python.filterPushdown.enabled"
# Logical tables of a cruise database, as read by the reference.
CRUISE_TABLES = ("sfl", "outlier", "stat", "filter", "filter_plan", "gating", "poly", "gating_plan")


def _spark_type(declared: str) -> str:
    d = (declared or "").upper()
    if "INT" in d:
        return "bigint"
    if any(t in d for t in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return "double"
    if "BOOL" in d:
        return "boolean"
    return "string"


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


# --------------------------------------------------------------------------- filters

#: Storage classes that hold a column's values as Spark sees them.
_STORED = {"bigint": "integer", "double": "real", "string": "text"}
_COMPARE = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
EXACT = 2 ** 53
#: Values of one IN list that go to the database.
MOST_VALUES = 500


def _condition(f, kinds: dict[str, str]) -> tuple[str, list] | None:
    """SQL that holds for every row for which a Spark filter may hold, and its values; None if there is none."""
    if isinstance(f, Not):
        inner = f.child
        if not isinstance(inner, (EqualTo, In)):
            return None
        return _stored(inner, kinds, "NOT ")
    if isinstance(f, IsNotNull):
        return (f"{_quote(f.attribute[0])} IS NOT NULL", []) if len(f.attribute) == 1 and f.attribute[0] in kinds else None
    return _stored(f, kinds)


def _stored(f, kinds: dict[str, str], prefix: str = "") -> tuple[str, list] | None:
    """A condition on one column, or a value in it that isn't stored as declared."""
    name = f.attribute[0] if len(f.attribute) == 1 else None
    stored = _STORED.get(kinds.get(name, ""))
    if stored is None:
        return None
    c, typed = _quote(name), {"integer": int, "real": (int, float), "text": str}[stored]
    if isinstance(f, IsNull):
        sql, values = f"{c} IS NULL", []
    elif isinstance(f, In):
        values = [v for v in f.value if v is not None]
        if len(values) > MOST_VALUES or len(values) < len(f.value):
            return None
        sql = f"{c} COLLATE BINARY IN ({', '.join('?' * len(values))})"
    elif type(f) in _COMPARE:
        sql, values = f"{c} COLLATE BINARY {_COMPARE[type(f)]} ?", [f.value]
    elif isinstance(f, (StringStartsWith, StringEndsWith, StringContains)) and stored == "text" and f.value:
        sql, values = {StringStartsWith: (f"substr({c}, 1, ?) = ?", [len(f.value), f.value]),
                       StringEndsWith: (f"substr({c}, ?) = ?", [-len(f.value), f.value]),
                       StringContains: (f"instr({c}, ?) > 0", [f.value])}[type(f)]
        return f"(({sql}) OR typeof({c}) NOT IN ('text', 'null'))", values
    else:
        return None
    if any(isinstance(v, bool) or not isinstance(v, typed) or v != v for v in values):  # NaN is NULL to SQLite
        return None
    if stored == "real":  # whole numbers compare alike as far as a double tells them apart
        told = f"typeof({c}) NOT IN ('real', 'integer', 'null') OR {c} NOT BETWEEN {-EXACT} AND {EXACT}"
    else:
        told = f"typeof({c}) NOT IN ('{stored}', 'null')"
    return f"({prefix}({sql}) OR {told})", values


def _cruise_holds(f, cruise: str) -> bool | None:
    """Whether a filter on the cruise holds for a file; None if it isn't such a filter."""
    if isinstance(f, Not):
        inner = _cruise_holds(f.child, cruise)
        return None if inner is None else not inner
    if getattr(f, "attribute", None) != (CRUISE,):
        return None
    tests = {EqualTo: lambda v: cruise == v, EqualNullSafe: lambda v: cruise == v, In: lambda v: cruise in v,
             StringStartsWith: lambda v: cruise.startswith(v), StringEndsWith: lambda v: cruise.endswith(v), StringContains: lambda v: v in cruise}
    if isinstance(f, (IsNotNull, IsNull)):
        return isinstance(f, IsNotNull)
    if type(f) not in tests or f.value is None or isinstance(f, In) and None in f.value:
        return None
    return tests[type(f)](f.value)


# --------------------------------------------------------------------------- reader

class _RowidRanges(InputPartition):
    """What one task reads: (path, first rowid, last rowid, columns the file has), from one file or several small ones."""

    def __init__(self, ranges: list):
        super().__init__(ranges)
        self.ranges = ranges


#: Rows that one task reads, about.
PARTITION_ROWS = 100_000
BATCH_ROWS = 10_000


def cruise_of(path: str) -> str:
    """S12 for a database: file name before its first dot."""
    return path.rstrip("/").split("/")[-1].split(".")[0]


def _connected(path: str):
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _columns_of(con, table: str) -> dict[str, str]:
    """The table's columns with their types, in order; none if there is no such table."""
    return {c[1]: _spark_type(c[2]) for c in con.execute(f"PRAGMA table_info({_quote(table)})").fetchall()}


class _SQLiteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.paths = json.loads(options["paths"])
        self.table = options["table"]
        self.where = options.get("where", "")
        self.schema = schema
        self.pushed: list[tuple[str, list, str]] = []

    def pushFilters(self, filters):
        """Predicates on the cruise pick files and are settled; others go to the database where they can, and Spark
        checks them again, as a value may not be stored as declared."""
        kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields if f.name != CRUISE}
        for f in filters:
            holds = [_cruise_holds(f, cruise_of(p)) for p in self.paths]
            if holds and None not in holds:
                self.paths = [p for p, h in zip(self.paths, holds, strict=True) if h]
                continue
            if (found := _condition(f, kinds)) is not None:
                child = f.child if isinstance(f, Not) else f
                self.pushed.append((*found, child.attribute[0]))
            if not self.paths and _cruise_holds(f, "") is not None:
                continue
            yield f

    def partitions(self):
        parts, held, size = [], [], 0
        for path in self.paths:
            con = _connected(path)
            try:
                have = list(_columns_of(con, self.table))
                lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quote(self.table)}").fetchone()
            finally:
                con.close()
            for at in range(lo, hi + 1, PARTITION_ROWS) if lo is not None else ():
                last = min(hi, at + PARTITION_ROWS - 1)
                if held and size + last - at >= PARTITION_ROWS:
                    parts.append(_RowidRanges(held))
                    held, size = [], 0
                held.append((path, at, last, have))
                size += last - at + 1
        return [*parts, _RowidRanges(held)]

    def statement(self, have: list[str]) -> tuple[str, list]:
        """The SELECT for a file with these columns, and the values of its conditions (after the rowid bounds)."""
        fields = [f.name for f in self.schema.fields if f.name != CRUISE]
        held = {n.lower() for n in have}
        lacking = [n for n in dict.fromkeys([*fields, *[p[2] for p in self.pushed]]) if n.lower() not in held]
        source = ", ".join(["*", *(f"NULL AS {_quote(n)}" for n in lacking)])
        where = [*([f"({self.where})"] if self.where else []), *[p[0] for p in self.pushed]]
        sql = (f"SELECT {', '.join(map(_quote, fields)) or '1'} FROM (SELECT {source} FROM {_quote(self.table)} WHERE rowid BETWEEN ? AND ?)"
               + (f" WHERE {' AND '.join(where)}" if where else ""))
        return sql, [v for p in self.pushed for v in p[1]]

    def read(self, partition):
        """Yield Arrow record batches of up to ``BATCH_ROWS`` rows (columnar hand-off)."""
        import pyarrow as pa
        fields = [f for f in self.schema.fields if f.name != CRUISE]
        types = [_ARROW.get(f.dataType.simpleString(), pa.string()) for f in fields]
        names = [f.name for f in self.schema.fields]
        for path, lo, hi, have in partition.ranges:
            sql, values = self.statement(have)
            con = _connected(path)
            try:
                cur = con.execute(sql, (lo, hi, *values))
                while rows := cur.fetchmany(BATCH_ROWS):
                    cols = {f.name: _column(values_, t, f.dataType.simpleString())
                            for f, t, values_ in zip(fields, types, zip(*rows))}
                    cols[CRUISE] = pa.array([cruise_of(path)] * len(rows), pa.string())
                    yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)
            finally:
                con.close()


#: Column with the cruise that a row's file belongs to.
CRUISE = "cruise"


def _column(values, arrow_type, kind: str):
    """One column as an Arrow array; value by value only where SQLite holds other types than declared."""
    import pyarrow as pa
    try:
        return pa.array(values, type=arrow_type)
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
        cast = _caster(kind)
        return pa.array([cast(v) for v in values], type=arrow_type)


def _arrow_types():
    import pyarrow as pa
    return {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


_ARROW = _arrow_types()


def _caster(t: str):
    def to_int(v):
        try:
            return None if v is None else int(v)
        except (TypeError, ValueError):
            return None

    def to_float(v):
        try:
            return None if v is None else float(v)
        except (TypeError, ValueError):
            return None

    def to_bool(v):
        return None if v is None else bool(v)

    def to_str(v):
        return None if v is None else str(v)

    return {"bigint": to_int, "double": to_float, "boolean": to_bool}.get(t, to_str)


class SQLiteDataSource(DataSource):
    """Read one table of SQLite files, split into rowid ranges."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        paths, table = json.loads(self.options["paths"]), self.options["table"]
        found: dict[str, str] = {}
        for path in paths:
            con = _connected(path)
            try:
                kinds = _columns_of(con, table)
            finally:
                con.close()
            if not kinds:
                raise ValueError(f"table {table!r} not found in {path}")
            for name, kind in kinds.items():  # SQLite's names have no case: the first spelling stays
                name = next((n for n in found if n.lower() == name.lower()), name)
                found[name] = widened(found.get(name, kind), kind)
        names = json.loads(self.options.get("columns", "null")) or list(found)
        missing = [n for n in names if n not in found]
        if missing:
            raise ValueError(f"table {table!r} in {', '.join(paths)} lacks columns {missing}")
        return ", ".join([*(f"`{n}` {found[n]}" for n in names if n != CRUISE), f"`{CRUISE}` string"])

    def reader(self, schema):
        return _SQLiteReader(self.options, schema)


def register_sqlite(spark: SparkSession) -> None:
    """Register the source (and ship this package to executors, where it runs)."""
    from cytotide.session import ship_code
    ship_code(spark)
    spark.conf.set(PUSH_CONF, "true")
    spark.dataSource.register(SQLiteDataSource)


def read_sqlite(spark: SparkSession, db, table: str, columns=None, where: str | None = None) -> DataFrame:
    """One table of one or many cruise databases in one scan; ``cruise`` is each
    file's name before its first dot. ``columns`` and ``where`` (SQLite SQL) go to the database, and
    so do filters on the result (``pushFilters``). Columns that some of the files lack are NULL there."""
    register_sqlite(spark)
    paths = [db] if isinstance(db, str) else list(db)
    reader = spark.read.format(FORMAT).option("paths", json.dumps(paths)).option("table", table)
    if columns is not None:
        reader = reader.option("columns", json.dumps(list(columns)))
    if where:
        reader = reader.option("where", where)
    return reader.load()


def read_sfl_with_flags(spark: SparkSession, db, key: str = "file_id") -> DataFrame:
    """SFL rows with the outlier flag of their file (left join on cruise and
    ``key``; the outlier table has one row per file, so it is a bounded side)."""
    sfl = read_sqlite(spark, db, "sfl")
    out = read_sqlite(spark, db, "outlier")
    return sfl.drop("flag").join(out.select(CRUISE, key, "flag"), on=[CRUISE, key], how="left")
