"""S2 end to end: cruise databases are written from the test tables, found through
the file catalog, and read back by the SQLite source into the flows."""

from __future__ import annotations

import os
import re
import uuid
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytotide.functions.columns import REFRAC
from cytotide.operators import active_at, exclude_flags, keep_quantile
from cytotide.plans import (active_gating, active_polygons, filter_intervals, filter_param_segments, gating_intervals,
                            sfl_metrics)
from cytotide.session import checkpoint_dir, ship_code
from cytotide.sources import (grid_bins, list_files, read_gridded, read_sfl_with_flags, read_sqlite,
                              sfl_series, stat_series)
from cytotide.sources.tables import STAT_COLUMNS
from workload import standins as S
from workload.registry import register

#: A cruise is a user id modulo this; each has a database of its own.
CRUISES = 24

_DDL = {
    "stat": "time TEXT, pop TEXT, quantile REAL, opp_evt_ratio REAL, n_count INTEGER, abundance REAL, fsc_med REAL, "
            "chl_med REAL, pe_med REAL, diam_mid_med REAL, flag INTEGER",
    "sfl": "file_id TEXT, date TEXT, lat TEXT, lon TEXT, conductivity REAL, salinity REAL, ocean_tmp REAL, par REAL, "
           "stream_pressure REAL, event_rate REAL",
    "outlier": "file_id TEXT, flag INTEGER",
    "filter_plan": "start_date TEXT, filter_id INTEGER",
    "filter": "id INTEGER, quantile REAL, beads_fsc_small REAL, beads_D1 REAL, beads_D2 REAL",
    "gating_plan": "start_date INTEGER, gating_id INTEGER",
    "gating": "id INTEGER, pop TEXT, channel1 TEXT, channel2 TEXT, pop_order INTEGER",
    "poly": "gating_id INTEGER, pop TEXT, fsc_small REAL, chl_small REAL, pe REAL, point_order INTEGER",
}
_COLUMNS = {t: [c.split()[0] for c in ddl.split(", ")] for t, ddl in _DDL.items()}


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables of all cruise databases, with ``no``, the cruise's number."""
    e = S.table(spark, sf, "events").withColumn("no", F.col("user_id") % CRUISES)
    ts, no = F.col("ts").cast("timestamp"), F.col("no")
    stat = S.stat_raw_from(e, keep=["no"]).withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    file_id = F.col("event_id").cast("string").alias("file_id")
    sfl = e.select(no, file_id, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.col("value").cast("string").alias("lat"),
                   F.when(F.col("event_id") % 13 == 0, "n/a").otherwise((-F.col("value")).cast("string")).alias("lon"),
                   (F.col("value") * 0.1).alias("conductivity"), (F.col("value") * 0.2).alias("salinity"),
                   (F.col("value") * 0.3).alias("ocean_tmp"), (F.col("value") * 10.0).alias("par"),
                   (F.col("user_id") * 0.01).alias("stream_pressure"), F.get_json_object("props", "$.k").cast("double").alias("event_rate"))
    p = S.filter_params(spark, sf).withColumn("no", F.col("id") % CRUISES).withColumn("id", F.floor(F.col("id") / CRUISES))
    c = S.table(spark, sf, "customer").withColumn("no", F.col("c_custkey") % CRUISES)
    pop = F.lower("c_mktsegment").alias("pop")
    return {
        "stat": stat, "sfl": sfl,
        "outlier": e.where(F.col("event_id") % 11 != 0).select(no, file_id, (F.col("user_id") % 4).alias("flag")),
        "filter_plan": e.select(no, F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("start_date"),
                                F.floor(F.col("user_id") / CRUISES).alias("filter_id")),
        "filter": p.select("no", *_COLUMNS["filter"]),
        "gating_plan": e.select(no, F.unix_seconds(ts).alias("start_date"), (F.col("user_id") % 20).alias("gating_id")),
        "gating": c.select("no", F.col("c_nationkey").alias("id"), pop, F.lit("fsc_small").alias("channel1"),
                           F.lit("pe").alias("channel2"), F.lit(1).alias("pop_order")).distinct(),
        "poly": c.select("no", F.col("c_nationkey").alias("gating_id"), pop, F.col("c_acctbal").alias("fsc_small"),
                         F.col("c_custkey").cast("double").alias("chl_small"), (F.col("c_acctbal") / 2.0).alias("pe"),
                         F.col("c_custkey").alias("point_order")),
    }


#: Rows in one database file, about.
FILE_ROWS = 1_000_000


def _writer(folder: str, old: bool):
    """Writes the rows of whole (cruise, part)s, sorted by these and table, a database each, and tells their paths. A file
    is written under a name of its own and then renamed, so a task that runs again leaves the same files."""
    def write(batches):
        import sqlite3

        import pyarrow as pa
        con, at, path, wrote = None, None, None, []

        def finish():
            con.commit()
            con.close()
            os.replace(f"{path}.{tag}", path)
            wrote.append(path)

        tag = uuid.uuid4().hex
        for b in batches:
            start = 0
            for (no, part, table), run in groupby(zip(*(b.column(i).to_pylist() for i in range(3)))):
                n = sum(1 for _ in run)
                if (no, part) != at:
                    if con:
                        finish()
                    at, path = (no, part), f"{folder}/C{no}.{part}.outlier.db"
                    con, made = sqlite3.connect(f"{path}.{tag}"), set()
                    con.execute("PRAGMA journal_mode = OFF")  # a file that isn't finished has no reader
                    con.execute("PRAGMA synchronous = OFF")
                columns = _columns(table, old and no % 2 == 1)
                if table not in made:
                    con.execute(f'CREATE TABLE "{table}" ({", ".join(columns)})')
                    made.add(table)
                names = _COLUMNS[table]
                values = b.column(3).slice(start, n).flatten().to_numpy(zero_copy_only=False).tolist()  # row after row
                rows = zip(*(values[i::len(names)] for i, c in enumerate(names) if len(columns) == len(names) or c not in _NEW))
                con.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(columns))})', rows)
                start += n
        if con:
            finish()
        yield pa.RecordBatch.from_pydict({"path": pa.array(wrote, pa.string())})
    return write


#: Columns that databases of an older kind lack, and a type that they declare differently.
_NEW = ("chl_med",)
_OLD_TYPES = {"n_count INTEGER": "n_count REAL"}


def _columns(table: str, old: bool) -> list[str]:
    declared = _DDL[table].split(", ")
    return [_OLD_TYPES.get(c, c) for c in declared if c.split()[0] not in _NEW] if old else declared


_WRITTEN: dict[tuple, str] = {}


def _shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the checkpoint folder, as a plain path: SQLite opens files on a mount, not in an object store."""
    base = checkpoint_dir(spark)
    if re.match(r"\w+:", base) and not base.startswith("file:"):
        raise RuntimeError(f"SQLite databases need a mounted folder that all executors see, not {base}")
    folder = os.path.join(re.sub(r"^file:/*", "/", base), f"{what}-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def _databases(spark: SparkSession, sf: str, *names: str, old: bool = False) -> list[str]:
    """Paths of the cruise databases with these tables, found through the catalog's listing; written once per
    session. ``old``: those of odd cruises lack a column and declare another type."""
    key = (spark.sparkContext.applicationId, sf, names, old)
    if key not in _WRITTEN:
        ship_code(spark, os.path.dirname(os.path.abspath(__file__)))  # the writer runs on executors
        folder = _shared_folder(spark, "cruises")
        tables = _tables(spark, sf)
        n = S.table(spark, sf, "events").count()
        parts = 1 + n * 3 * len(names) // (CRUISES * FILE_ROWS)
        rows = None
        for name in names:
            values = F.array(*[F.col(c).cast("string") for c in _COLUMNS[name]])
            one = tables[name].select("no", F.pmod(F.xxhash64(values), F.lit(parts)).alias("part"), F.lit(name).alias("table"), values.alias("v"))
            rows = one if rows is None else rows.unionByName(one)
        rows.repartition("no", "part").sortWithinPartitions("no", "part", "table").mapInArrow(_writer(folder, old), "path string").count()
        _WRITTEN[key] = folder
    registry = spark.createDataFrame([("set", _WRITTEN[key], True)], "name string, dir string, default boolean")
    return sorted(r.item for r in list_files(spark, registry).where("kind = 'outlier_db'").collect())


def _cruise_dbs(spark, sf):
    return _databases(spark, sf, *_DDL)


SQLITE_CTES = f"""
ev AS (SELECT *, 'C' || CAST(user_id % {CRUISES} AS VARCHAR) AS cruise, CAST(ts AS TIMESTAMP) AS t,
              date_trunc('second', CAST(ts AS TIMESTAMP)) AS t0 FROM events),
st AS (
  SELECT cruise, t AS time, event_type AS pop, value / 100.0::DOUBLE AS opp_evt_ratio,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS n_count,
         value AS abundance, value * 3.0::DOUBLE AS fsc_med,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 2.0::DOUBLE END AS chl_med,
         value + user_id AS pe_med, sqrt(value) AS diameter,
         CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 4 END AS BIGINT) AS flag
  FROM ev WHERE user_id % 3 = 1),
pts AS (SELECT DISTINCT cruise, time FROM st WHERE flag IS NULL OR flag NOT IN (1, 2, 3)),
giv AS (SELECT cruise, t0 AS start_date, user_id % 20 AS gating_id,
               lead(t0) OVER (PARTITION BY cruise ORDER BY t0, user_id % 20) AS end_date FROM ev),
ga AS (SELECT p.cruise, p.time, g.start_date, g.end_date, g.gating_id FROM pts p
       JOIN giv g ON p.cruise = g.cruise AND g.start_date <= p.time AND (g.end_date IS NULL OR p.time < g.end_date)),
cp AS (SELECT 'C' || CAST(c_custkey % {CRUISES} AS VARCHAR) AS cruise, c_nationkey AS gating_id, lower(c_mktsegment) AS pop,
              c_acctbal AS fsc_small, CAST(c_custkey AS DOUBLE) AS chl_small, c_acctbal / 2.0::DOUBLE AS pe,
              c_custkey AS point_order FROM customer)"""


def _stat(spark, dbs):
    """Stat rows of quantile 50; the condition and the columns are the database's work."""
    columns = [*STAT_COLUMNS, "quantile", f"diam_{REFRAC}_med", "flag"]
    return stat_series(read_sqlite(spark, dbs, "stat", columns=columns, where="quantile = 50"), by=["cruise"])


@register("sqlite_stat", "WITH " + SQLITE_CTES + " SELECT * FROM st")
def q_sqlite_stat(spark, sf):
    """S2 + S5: the Stat tables of all cruise databases in one scan, time as text in the databases."""
    return _stat(spark, _databases(spark, sf, "stat"))


@register("sqlite_stat_window", "WITH " + SQLITE_CTES + """
SELECT * FROM st WHERE cruise IN ('C1', 'C4', 'C7', 'C10') AND time >= TIMESTAMP '2024-01-08' AND time < TIMESTAMP '2024-01-20'
  AND pop <> 'view'""")
def q_sqlite_stat_window(spark, sf):
    """S2 + P7: a window of some cruises; Spark's filters are the databases' work, and other cruises' files stay closed."""
    raw = read_sqlite(spark, _databases(spark, sf, "stat"), "stat")
    some = raw.where("cruise IN ('C1', 'C4', 'C7', 'C10') AND quantile = 50 AND time >= '2024-01-08' AND time < '2024-01-20' AND pop <> 'view'")
    return stat_series(some, by=["cruise"])


@register("sqlite_merged_columns", "WITH " + SQLITE_CTES + f"""
SELECT cruise, time, pop, CAST(n_count AS DOUBLE) AS n_count, abundance,
       CASE WHEN CAST(substr(cruise, 2) AS INTEGER) % 2 = 0 THEN chl_med END AS chl_med, flag FROM st""")
def q_sqlite_merged_columns(spark, sf):
    """S2 + G4: databases of two kinds in one scan; a column that a cruise's database lacks is NULL, types are widened."""
    raw = read_sqlite(spark, _databases(spark, sf, "stat", old=True), "stat").where("quantile = 50")
    return stat_series(raw, by=["cruise"]).select("cruise", "time", "pop", "n_count", "abundance", "chl_med", "flag")


@register("sqlite_sfl_flags", "WITH " + SQLITE_CTES + """
SELECT cruise, t0 AS time, value AS lat, CASE WHEN event_id % 13 = 0 THEN NULL ELSE -value END AS lon,
       value * 0.1::DOUBLE AS conductivity, value * 0.2::DOUBLE AS salinity, value * 0.3::DOUBLE AS ocean_tmp,
       value * 10.0::DOUBLE AS par, user_id * 0.01::DOUBLE AS stream_pressure,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS event_rate,
       CASE WHEN event_id % 11 <> 0 THEN CAST(user_id % 4 AS BIGINT) END AS flag
FROM ev WHERE event_id % 11 = 0 OR user_id % 4 NOT IN (1, 2, 3)""")
def q_sqlite_sfl_flags(spark, sf):
    """S2 + S4 + Q3: SFL rows with their files' outlier flags, flagged ones excluded."""
    return sfl_metrics(read_sfl_with_flags(spark, _cruise_dbs(spark, sf)), by=["cruise"])


@register("sqlite_filter_segments", "WITH " + SQLITE_CTES + f""",
caps AS (SELECT cruise, max(t0) AS cap FROM ev GROUP BY cruise),
iv AS (
  SELECT e.cruise, start_date, filter_id, CASE WHEN rn = cnt AND end0 IS NULL THEN cap ELSE end0 END AS end_date
  FROM (SELECT cruise, t0 AS start_date, user_id // {CRUISES} AS filter_id,
               lead(t0) OVER w AS end0, row_number() OVER w AS rn, count(*) OVER (PARTITION BY cruise) AS cnt
        FROM ev WINDOW w AS (PARTITION BY cruise ORDER BY t0, user_id // {CRUISES})) e JOIN caps USING (cruise)),
ps AS (SELECT 'C' || CAST(id % {CRUISES} AS VARCHAR) AS cruise, id // {CRUISES} AS id, beads_fsc_small, beads_D1, beads_D2 FROM fp50),
ivp AS (SELECT iv.*, ps.* EXCLUDE (cruise, id) FROM iv LEFT JOIN ps ON iv.cruise = ps.cruise AND iv.filter_id = ps.id)
SELECT cruise, filter_id, start_date, end_date, param, y_value FROM (
  SELECT cruise, filter_id, start_date, end_date, 'beads_fsc_small' AS param, beads_fsc_small AS y_value FROM ivp
  UNION ALL SELECT cruise, filter_id, start_date, end_date, 'beads_D1', beads_D1 FROM ivp
  UNION ALL SELECT cruise, filter_id, start_date, end_date, 'beads_D2', beads_D2 FROM ivp)
WHERE start_date IS NOT NULL AND end_date IS NOT NULL AND y_value IS NOT NULL""")
def q_sqlite_filter_segments(spark, sf):
    """Q5 from databases alone: filter plan with text dates, parameters, and the last SFL time as the cap, per cruise."""
    dbs = _cruise_dbs(spark, sf)
    caps = sfl_series(read_sfl_with_flags(spark, dbs), by=["cruise"]).groupBy("cruise").agg(F.max("time").alias("max_time"))
    params = keep_quantile(read_sqlite(spark, dbs, "filter"), 50).drop("quantile")
    iv = filter_intervals(read_sqlite(spark, dbs, "filter_plan"), params, max_time=caps, by=["cruise"])
    return filter_param_segments(iv, by=["cruise"])


@register("sqlite_active_gating", "WITH " + SQLITE_CTES + """
SELECT a.cruise, a.time, strftime(a.start_date, '%Y-%m-%dT%H:%M:%SZ') AS start_date,
       strftime(a.end_date, '%Y-%m-%dT%H:%M:%SZ') AS end_date, a.gating_id, g.pop,
       CASE WHEN g.pop IS NOT NULL THEN 'fsc_small' END AS channel1, CASE WHEN g.pop IS NOT NULL THEN 'pe' END AS channel2,
       CASE WHEN g.pop IS NOT NULL THEN 1::BIGINT END AS pop_order
FROM ga a LEFT JOIN (SELECT DISTINCT cruise, gating_id, pop FROM cp) g USING (cruise, gating_id)""")
def q_sqlite_active_gating(spark, sf):
    """Q8 from databases alone: gating plan with epoch dates and gating definitions at every Stat point of a cruise."""
    dbs = _cruise_dbs(spark, sf)
    points = exclude_flags(_stat(spark, dbs))
    iv = gating_intervals(read_sqlite(spark, dbs, "gating_plan"), by=["cruise"])
    return active_gating(points, iv, read_sqlite(spark, dbs, "gating"), by=["cruise"])


@register("sqlite_active_polygons", "WITH " + SQLITE_CTES + """
SELECT cp.*, a.time FROM cp JOIN (SELECT DISTINCT cruise, time, gating_id FROM ga) a USING (cruise, gating_id)""")
def q_sqlite_active_polygons(spark, sf):
    """J7 from databases alone: polygon vertices of the gates active at every Stat point of a cruise."""
    dbs = _cruise_dbs(spark, sf)
    points = exclude_flags(_stat(spark, dbs)).select("cruise", "time").distinct()
    iv = gating_intervals(read_sqlite(spark, dbs, "gating_plan"), by=["cruise"])
    act = active_at(points, iv, by=["cruise"], how="inner", disjoint=True, distinct=True)
    return active_polygons(read_sqlite(spark, dbs, "poly"), act, by=["cruise"])


@register("grid_files_decode", """
SELECT 'CR1' AS cruise, date, pop, n, Qc_sum, fsc_small, chl_small, pe, Qc, diam FROM decoded""")
def q_grid_files_decode(spark, sf):
    """S8 + J11: grid bins and hourly counts written as files; the bins' positions are the file's row numbers."""
    from cytotide.operators import decode_bins
    folder = f"{checkpoint_dir(spark)}/grid-{uuid.uuid4().hex}/grid"
    bins = S.grid_bins_raw(spark, sf)
    last = bins.agg(F.max("idx").alias("n"))
    filled = last.select(F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("idx")).join(bins, "idx", "left")
    filled.repartition(1).sortWithinPartitions("idx").drop("idx").write.parquet(f"{folder}/CR1.grid_bins.parquet")
    S.gridded_raw(spark, sf).write.parquet(f"{folder}/CR1.hourly_gridded.parquet")
    bins = grid_bins(spark, f"{folder}/CR1.grid_bins.parquet", with_cruise=False)
    gridded = read_gridded(spark, f"{folder}/CR1.hourly_gridded.parquet", with_cruise=False)
    return decode_bins(gridded, bins).select("*", F.lit("CR1").alias("cruise"))
