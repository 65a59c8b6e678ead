"""Stand-in inputs built from the driver's test tables.

The cruise tables of the reference do not exist in the test data, so each
input role is given rows of the expected schema derived from a test table
(see FIXTURES.md). These builders only rename, cast and derive columns —
they do none of the operators' work. Every builder has a DuckDB twin (a CTE)
with the same derivation, so each query has an SQL oracle over the same rows.

Two time worlds exist in the test data: ``events`` covers January 2024 (used
for Stat / SFL points and the plans that act on them) and ``orders`` /
``lineitem`` cover 1995-2001 (used for particles, gridded counts and the
plan acting on them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one test table; its schema is inferred once per path and then
    passed explicitly (schema inference costs a Spark job per read)."""
    path = f"{sf_dir}/{name}.parquet"
    schema = _SCHEMAS.get(path)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[path] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)


def _quantile_of(c):
    return F.when(c % 3 == 0, F.lit(2.5)).when(c % 3 == 1, F.lit(50.0)).otherwise(F.lit(97.5))


# ------------------------------------------------------------------ events world

def stat_raw(spark, sf):
    """Stat table: one row per event (time, pop = event type, metrics)."""
    return stat_raw_from(table(spark, sf, "events"))


def stat_raw_from(e: DataFrame, keep=()) -> DataFrame:
    """Stat rows from an events frame; ``keep`` columns (e.g. a cruise key) are carried."""
    return e.select(
        *keep,
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_type").alias("pop"),
        _quantile_of(F.col("user_id")).alias("quantile"),
        (F.col("value") / 100.0).alias("opp_evt_ratio"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None))
         .otherwise(F.get_json_object("props", "$.k").cast("bigint")).alias("n_count"),
        F.col("value").alias("abundance"),
        (F.col("value") * 3.0).alias("fsc_med"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value") * 2.0).alias("chl_med"),
        (F.col("value") + F.col("user_id")).alias("pe_med"),
        F.sqrt("value").alias("diam_mid_med"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("user_id") % 4)
         .cast("int").alias("flag"),
    )


STAT_RAW_SQL = """stat_raw AS (
  SELECT CAST(ts AS TIMESTAMP) AS time, event_type AS pop,
         CASE user_id % 3 WHEN 0 THEN 2.5::DOUBLE WHEN 1 THEN 50.0::DOUBLE ELSE 97.5::DOUBLE END AS quantile,
         value / 100.0::DOUBLE AS opp_evt_ratio,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS n_count,
         value AS abundance, value * 3.0::DOUBLE AS fsc_med,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 2.0::DOUBLE END AS chl_med,
         value + user_id AS pe_med, sqrt(value) AS diam_mid_med,
         CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 4 END AS INTEGER) AS flag
  FROM events)"""


def sfl_raw(spark, sf):
    """SFL table: one row per event; lat/lon as text (with unparseable text)."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("date"),
        F.col("value").cast("string").alias("lat"),
        F.when(F.col("event_id") % 13 == 0, F.lit("n/a"))
         .otherwise((-F.col("value")).cast("string")).alias("lon"),
        (F.col("value") * 0.1).alias("conductivity"),
        (F.col("value") * 0.2).alias("salinity"),
        (F.col("value") * 0.3).alias("ocean_tmp"),
        (F.col("value") * 10.0).alias("par"),
        (F.col("user_id") * 0.01).alias("stream_pressure"),
        F.get_json_object("props", "$.k").cast("double").alias("event_rate"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("user_id") % 4)
         .cast("int").alias("flag"),
    )


SFL_RAW_SQL = """sfl_raw AS (
  SELECT CAST(ts AS TIMESTAMP) AS date, CAST(value AS VARCHAR) AS lat,
         CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(-value AS VARCHAR) END AS lon,
         value * 0.1::DOUBLE AS conductivity, value * 0.2::DOUBLE AS salinity,
         value * 0.3::DOUBLE AS ocean_tmp, value * 10.0::DOUBLE AS par,
         user_id * 0.01::DOUBLE AS stream_pressure,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS event_rate,
         CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 4 END AS INTEGER) AS flag
  FROM events)"""


def event_filter_plan(spark, sf):
    """Filter plan acting on Stat points: every event starts a parameter set."""
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("start_date"), F.col("user_id").alias("filter_id"))


EVENT_FILTER_PLAN_SQL = """event_filter_plan AS (
  SELECT CAST(ts AS TIMESTAMP) AS start_date, user_id AS filter_id FROM events)"""


def gating_plan(spark, sf):
    """Gating plan: every event starts a gating set; of the 25 gating ids that have polygons, 20 are used."""
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("start_date"), (F.col("user_id") % 20).alias("gating_id"))


GATING_PLAN_SQL = """gating_plan AS (
  SELECT CAST(ts AS TIMESTAMP) AS start_date, user_id % 20 AS gating_id FROM events)"""


def gating_spans(spark, sf):
    """Overlapping gating intervals, some without an id: half an hour from every event on."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        ts.alias("start_date"), (ts + F.expr("INTERVAL 30 MINUTES")).alias("end_date"),
        F.when(F.col("event_id") % 9 != 0, F.col("user_id") % 20).alias("gating_id"))


GATING_SPANS_SQL = """gating_spans AS (
  SELECT CAST(ts AS TIMESTAMP) AS start_date, CAST(ts AS TIMESTAMP) + INTERVAL 30 MINUTE AS end_date,
         CASE WHEN event_id % 9 <> 0 THEN user_id % 20 END AS gating_id FROM events)"""


# ------------------------------------------------------------------ parameters

def filter_params(spark, sf):
    """Filter parameters, one row per (id, quantile), from part."""
    p = table(spark, sf, "part")
    price = F.col("p_retailprice")
    q = F.explode(F.array(F.lit(2.5), F.lit(50.0), F.lit(97.5))).alias("quantile")
    base = p.select("p_partkey", "p_size", "p_retailprice", q)
    size = F.col("p_size").cast("double")
    return base.select(
        F.col("p_partkey").alias("id"), "quantile",
        F.lit(None).cast("timestamp").alias("date"),
        (price * 10.0 * F.col("quantile") / 50.0).alias("beads_fsc_small"),
        price.alias("beads_D1"),
        F.when(F.col("p_size") == 50, F.lit(None)).otherwise(price * 2.0).alias("beads_D2"),
        (size * 100.0).alias("width"),
        (size / 1000.0).alias("notch_small_D1"), price.alias("offset_small_D1"),
        (size / 2000.0).alias("notch_small_D2"), (price / 2.0).alias("offset_small_D2"),
        (size / 500.0).alias("notch_large_D1"), (-price).alias("offset_large_D1"),
        F.when(F.col("p_size") % 7 == 0, size / 2000.0).otherwise(size / 4000.0).alias("notch_large_D2"),
        F.when(F.col("p_size") % 11 == 0, F.lit(None)).otherwise(-price / 2.0).alias("offset_large_D2"),
    )


FILTER_PARAMS_SQL = """filter_params AS (
  SELECT p_partkey AS id, q.quantile, CAST(NULL AS TIMESTAMP) AS date,
         p_retailprice * 10.0::DOUBLE * q.quantile / 50.0::DOUBLE AS beads_fsc_small,
         p_retailprice AS beads_D1,
         CASE WHEN p_size = 50 THEN NULL ELSE p_retailprice * 2.0::DOUBLE END AS beads_D2,
         CAST(p_size AS DOUBLE) * 100.0::DOUBLE AS width,
         CAST(p_size AS DOUBLE) / 1000.0::DOUBLE AS notch_small_D1, p_retailprice AS offset_small_D1,
         CAST(p_size AS DOUBLE) / 2000.0::DOUBLE AS notch_small_D2, p_retailprice / 2.0::DOUBLE AS offset_small_D2,
         CAST(p_size AS DOUBLE) / 500.0::DOUBLE AS notch_large_D1, -p_retailprice AS offset_large_D1,
         CASE WHEN p_size % 7 = 0 THEN CAST(p_size AS DOUBLE) / 2000.0::DOUBLE
              ELSE CAST(p_size AS DOUBLE) / 4000.0::DOUBLE END AS notch_large_D2,
         CASE WHEN p_size % 11 = 0 THEN NULL ELSE -p_retailprice / 2.0::DOUBLE END AS offset_large_D2
  FROM part CROSS JOIN (VALUES (2.5::DOUBLE), (50.0::DOUBLE), (97.5::DOUBLE)) AS q(quantile))"""


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def gating(spark, sf):
    """Gating definitions: one row per (nation id, market segment as pop)."""
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    g = c.select(F.col("c_nationkey").alias("id"), seg).distinct()
    return g.select(
        "id", F.lower(seg).alias("pop"),
        F.when(seg == "AUTOMOBILE", "fsc_small").when(seg == "BUILDING", "pe")
         .when(seg == "FURNITURE", "fsc_small").when(seg == "HOUSEHOLD", "chl_small")
         .otherwise("fsc_small").alias("channel1"),
        F.when(seg == "AUTOMOBILE", "pe").when(seg == "BUILDING", "fsc_small")
         .when(seg == "FURNITURE", "chl_small").when(seg == "HOUSEHOLD", "pe")
         .otherwise(F.lit(None)).alias("channel2"),
        (F.when(seg == "AUTOMOBILE", 1).when(seg == "BUILDING", 2).when(seg == "FURNITURE", 3)
         .when(seg == "HOUSEHOLD", 4).otherwise(5)).alias("pop_order"),
    )


GATING_SQL = """gating AS (
  SELECT id, lower(seg) AS pop,
         CASE seg WHEN 'AUTOMOBILE' THEN 'fsc_small' WHEN 'BUILDING' THEN 'pe' WHEN 'FURNITURE' THEN 'fsc_small'
                  WHEN 'HOUSEHOLD' THEN 'chl_small' ELSE 'fsc_small' END AS channel1,
         CASE seg WHEN 'AUTOMOBILE' THEN 'pe' WHEN 'BUILDING' THEN 'fsc_small' WHEN 'FURNITURE' THEN 'chl_small'
                  WHEN 'HOUSEHOLD' THEN 'pe' ELSE NULL END AS channel2,
         CASE seg WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                  WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS pop_order
  FROM (SELECT DISTINCT c_nationkey AS id, c_mktsegment AS seg FROM customer))"""


def poly(spark, sf):
    """Polygon vertices: one per customer, on its (nation, segment) gate."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_nationkey").alias("gating_id"), F.lower("c_mktsegment").alias("pop"),
        F.col("c_acctbal").alias("fsc_small"),
        F.col("c_custkey").cast("double").alias("chl_small"),
        (F.col("c_acctbal") / 2.0).alias("pe"),
        F.col("c_custkey").alias("point_order"),
    )


POLY_SQL = """poly AS (
  SELECT c_nationkey AS gating_id, lower(c_mktsegment) AS pop, c_acctbal AS fsc_small,
         CAST(c_custkey AS DOUBLE) AS chl_small, c_acctbal / 2.0::DOUBLE AS pe, c_custkey AS point_order
  FROM customer)"""


# ------------------------------------------------------------------ lineitem world

def _daytime(day: str, key: str):
    """A minute between 10:00 and 13:00 of a date, by a key; the test table's dates have no time of day."""
    return F.col(day).cast("timestamp") + F.make_dt_interval(hours=F.lit(10), mins=(F.col(key) % 180).cast("int"))


def _daytime_sql(day: str, key: str) -> str:
    return f"CAST({day} AS TIMESTAMP) + INTERVAL 10 HOUR + to_minutes(CAST({key} % 180 AS INTEGER))"


def order_filter_plan(spark, sf):
    """Filter plan acting on particles: every order starts a parameter set (50 ids) at some minute of its day."""
    o = table(spark, sf, "orders")
    return o.select(_daytime("o_orderdate", "o_orderkey").alias("start_date"),
                    (F.col("o_custkey") % 50).alias("filter_id"))


ORDER_FILTER_PLAN_SQL = f"""order_filter_plan AS (
  SELECT {_daytime_sql('o_orderdate', 'o_orderkey')} AS start_date, o_custkey % 50 AS filter_id FROM orders)"""


def _pop_of(rf, ls):
    return (F.when(rf == "A", "prochloro").when(rf == "R", "synecho")
            .when(ls == "O", "unknown").otherwise("noise"))


_POP_SQL = ("CASE WHEN l_returnflag = 'A' THEN 'prochloro' WHEN l_returnflag = 'R' THEN 'synecho' "
            "WHEN l_linestatus = 'O' THEN 'unknown' ELSE 'noise' END")


def beads_raw(spark, sf):
    """Bead EVT sample (16-bit log-scale channels) from lineitem."""
    li = table(spark, sf, "lineitem")
    return li.select(
        _daytime("l_shipdate", "l_orderkey").alias("date"),
        F.col("l_orderkey").alias("file_id"),
        (F.col("l_extendedprice") / 2.0).alias("fsc_small"),
        (F.col("l_quantity") * 1000.0).alias("chl_small"),
        F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_tax") * 500000.0).alias("pe"),
        F.col("l_partkey").cast("double").alias("D1"),
        (F.col("l_suppkey") * 20.0).alias("D2"),
    )


BEADS_RAW_SQL = f"""beads_raw AS (
  SELECT {_daytime_sql('l_shipdate', 'l_orderkey')} AS date, l_orderkey AS file_id,
         l_extendedprice / 2.0::DOUBLE AS fsc_small, l_quantity * 1000.0::DOUBLE AS chl_small,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax * 500000.0::DOUBLE END AS pe,
         CAST(l_partkey AS DOUBLE) AS D1, l_suppkey * 20.0::DOUBLE AS D2
  FROM lineitem)"""


def vct_raw(spark, sf):
    """Hourly VCT rows (linear channels, all quantile flags) from lineitem."""
    li = table(spark, sf, "lineitem")
    return li.select(
        _daytime("l_shipdate", "l_orderkey").alias("date"),
        (F.col("l_linestatus") == "O").alias("q50"),
        _pop_of(F.col("l_returnflag"), F.col("l_linestatus")).alias("pop_q50"),
        (F.col("l_partkey") + 1).cast("double").alias("D1"),
        (F.col("l_suppkey") * 10.0 + 1.0).alias("D2"),
        (F.col("l_extendedprice") / 40.0).alias("fsc_small"),
        (F.col("l_quantity") * 10.0).alias("chl_small"),
        (F.col("l_tax") * 5000.0).alias("pe"),
        F.sqrt("l_quantity").alias("diam_mid_q50"),
        (F.col("l_extendedprice") / 1000.0).alias("Qc_mid_q50"),
        (F.col("l_suppkey") % 50).cast("double").alias("filter_id"),
        (F.col("l_orderkey") % 25).cast("double").alias("gating_id"),
    )


VCT_RAW_SQL = f"""vct_raw AS (
  SELECT {_daytime_sql('l_shipdate', 'l_orderkey')} AS date, l_linestatus = 'O' AS q50, {_POP_SQL} AS pop_q50,
         CAST(l_partkey + 1 AS DOUBLE) AS D1, l_suppkey * 10.0::DOUBLE + 1.0::DOUBLE AS D2,
         l_extendedprice / 40.0::DOUBLE AS fsc_small, l_quantity * 10.0::DOUBLE AS chl_small,
         l_tax * 5000.0::DOUBLE AS pe, sqrt(l_quantity) AS diam_mid_q50,
         l_extendedprice / 1000.0::DOUBLE AS Qc_mid_q50,
         CAST(l_suppkey % 50 AS DOUBLE) AS filter_id, CAST(l_orderkey % 25 AS DOUBLE) AS gating_id
  FROM lineitem)"""


def gridded_raw(spark, sf):
    """Hourly gridded counts from lineitem (coordinates are 1-based bin positions)."""
    li = table(spark, sf, "lineitem")
    qty = F.col("l_quantity").cast("int")
    return li.select(
        F.date_trunc("hour", _daytime("l_shipdate", "l_orderkey")).alias("date"),
        _pop_of(F.col("l_returnflag"), F.col("l_linestatus")).alias("pop"),
        qty.alias("fsc_small_coord"),
        (F.lit(51) - qty).alias("chl_small_coord"),
        (F.col("l_linenumber") * 8).alias("pe_coord"),
        (qty % 50 + 1).alias("Qc_coord"),
        F.col("l_linenumber").cast("bigint").alias("n"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("Qc_sum"),
    )


GRIDDED_RAW_SQL = f"""gridded_raw AS (
  SELECT date_trunc('hour', {_daytime_sql('l_shipdate', 'l_orderkey')}) AS date, {_POP_SQL} AS pop,
         CAST(l_quantity AS INTEGER) AS fsc_small_coord, 51 - CAST(l_quantity AS INTEGER) AS chl_small_coord,
         l_linenumber * 8 AS pe_coord, CAST(l_quantity AS INTEGER) % 50 + 1 AS Qc_coord,
         CAST(l_linenumber AS BIGINT) AS n,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_extendedprice END AS Qc_sum
  FROM lineitem)"""


def grid_bins_raw(spark, sf):
    """Grid-bin table: one row per position 1..50 (part sizes), exact min/max values."""
    p = table(spark, sf, "part")
    g = p.groupBy("p_size").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return g.select(F.col("p_size").cast("bigint").alias("idx"), F.col("lo").alias("fsc_small"),
                    F.col("hi").alias("chl_small"), (F.col("lo") / 10.0).alias("pe"),
                    (F.col("hi") / 100.0).alias("Qc"))


GRID_BINS_RAW_SQL = """grid_bins_raw AS (
  SELECT CAST(p_size AS BIGINT) AS idx, lo AS fsc_small, hi AS chl_small, lo / 10.0::DOUBLE AS pe,
         hi / 100.0::DOUBLE AS Qc
  FROM (SELECT p_size, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_size))"""


# ------------------------------------------------------------------ files and config

def catalog_paths(spark, sf, dup: bool = False):
    """Listed file paths of four data sets, one file per customer row.

    Customer ``k`` is data set ``set{k % 4}``, kind ``k % 5`` and cruise
    ``k // 20`` — every (data set, kind, cruise) once. With ``dup=True`` the
    cruise is ``k // 40``, so each combination appears twice. Data set
    ``set3`` has only grid files (its other files are unrelated text), and
    ``set2`` (the default) lacks its database for every third cruise.
    """
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    cruise_no = F.floor(k / (40 if dup else 20))
    name = F.concat(F.lit("set"), (k % 4).cast("string"))
    cruise = F.concat(F.lit("CR"), cruise_no.cast("string"))
    kind = k % 5
    root = F.concat(F.lit("/data/"), name)
    core_ok = name != F.lit("set3")
    db_ok = core_ok & ~((name == F.lit("set2")) & (cruise_no % 3 == 0))
    txt = F.concat(F.lit("/misc/"), cruise, F.lit(".notes.txt"))
    suffix = (F.when(kind == 0, F.when(db_ok, F.concat(F.lit("/db/"), cruise, F.lit(".outlier.db")))
                     .otherwise(txt))
              .when(kind == 1, F.when(core_ok, F.concat(F.lit("/beads/"), cruise,
                                                        F.lit(".beads-sample-2024.parquet")))
                    .otherwise(txt))
              .when(kind == 2, F.when(core_ok, F.concat(F.lit("/"), cruise,
                                                        F.lit("_vct/2024-01-01T00-00-00+00-00.1H.vct.parquet")))
                    .otherwise(txt))
              .when(kind == 3, F.concat(F.lit("/grid/"), cruise, F.lit(".grid_bins.parquet")))
              .otherwise(F.concat(F.lit("/grid/"), cruise, F.lit(".hourly_gridded.parquet"))))
    return c.select(name.alias("name"), (k % 4 == 2).alias("default"), root.alias("dir"),
                    F.concat(root, suffix).alias("path"))


def catalog_paths_sql(dup: bool = False) -> str:
    per = 40 if dup else 20
    cte = "catalog_paths_dup" if dup else "catalog_paths"
    return f"""{cte} AS (
  SELECT name, k % 4 = 2 AS "default", '/data/' || name AS dir,
         '/data/' || name || CASE kind
           WHEN 0 THEN CASE WHEN name <> 'set3' AND NOT (name = 'set2' AND cn % 3 = 0)
                            THEN '/db/' || cruise || '.outlier.db' ELSE '/misc/' || cruise || '.notes.txt' END
           WHEN 1 THEN CASE WHEN name <> 'set3' THEN '/beads/' || cruise || '.beads-sample-2024.parquet'
                            ELSE '/misc/' || cruise || '.notes.txt' END
           WHEN 2 THEN CASE WHEN name <> 'set3' THEN '/' || cruise || '_vct/2024-01-01T00-00-00+00-00.1H.vct.parquet'
                            ELSE '/misc/' || cruise || '.notes.txt' END
           WHEN 3 THEN '/grid/' || cruise || '.grid_bins.parquet'
           ELSE '/grid/' || cruise || '.hourly_gridded.parquet' END AS path
  FROM (SELECT c_custkey AS k, c_custkey // {per} AS cn, 'set' || CAST(c_custkey % 4 AS VARCHAR) AS name,
               'CR' || CAST(c_custkey // {per} AS VARCHAR) AS cruise, c_custkey % 5 AS kind FROM customer))"""


def registry_raw(spark, sf):
    """Registry rows (name, dir, default as free text) from customer."""
    c = table(spark, sf, "customer")
    m = F.col("c_custkey") % 7
    default = (F.when(m == 0, "TRUE").when(m == 1, "t").when(m == 2, " Yes ").when(m == 3, "no")
               .when(m == 4, F.lit(None)).when(m == 5, "1").otherwise("FALSE"))
    return c.select(F.col("c_name").alias("name"),
                    F.concat(F.lit("/data/"), F.lower("c_mktsegment")).alias("dir"),
                    default.alias("default"))


REGISTRY_RAW_SQL = """registry_raw AS (
  SELECT c_name AS name, '/data/' || lower(c_mktsegment) AS dir,
         CASE c_custkey % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN 't' WHEN 2 THEN ' Yes ' WHEN 3 THEN 'no'
                            WHEN 4 THEN NULL WHEN 5 THEN '1' ELSE 'FALSE' END AS "default"
  FROM customer)"""


def vct_names(spark, sf):
    """VCT file names (one per order): hour stamps with +00:00, -07:00 or no offset, some junk."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    ts = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(k % 24).cast("int"))
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")
    off = F.when(k % 3 == 0, "+00-00").when(k % 3 == 1, "-07-00").otherwise("")
    name = F.when(k % 17 == 0, F.concat(F.lit("junk-"), k.cast("string"), F.lit(".vct.parquet"))) \
        .otherwise(F.concat(stamp, off, F.lit(".1H.vct.parquet")))
    return o.select(k.alias("file_no"), (k % 3).alias("cruise_no"), name.alias("path"))


VCT_NAMES_SQL = """vct_names AS (
  SELECT o_orderkey AS file_no, o_orderkey % 3 AS cruise_no,
         CASE WHEN o_orderkey % 17 = 0 THEN 'junk-' || CAST(o_orderkey AS VARCHAR) || '.vct.parquet'
              ELSE strftime(CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)), '%Y-%m-%dT%H-%M-%S')
                   || CASE o_orderkey % 3 WHEN 0 THEN '+00-00' WHEN 1 THEN '-07-00' ELSE '' END
                   || '.1H.vct.parquet' END AS path
  FROM orders)"""


SQL_CTES = {
    "stat_raw": STAT_RAW_SQL,
    "sfl_raw": SFL_RAW_SQL,
    "event_filter_plan": EVENT_FILTER_PLAN_SQL,
    "gating_plan": GATING_PLAN_SQL,
    "gating_spans": GATING_SPANS_SQL,
    "filter_params": FILTER_PARAMS_SQL,
    "gating": GATING_SQL,
    "poly": POLY_SQL,
    "order_filter_plan": ORDER_FILTER_PLAN_SQL,
    "beads_raw": BEADS_RAW_SQL,
    "vct_raw": VCT_RAW_SQL,
    "gridded_raw": GRIDDED_RAW_SQL,
    "grid_bins_raw": GRID_BINS_RAW_SQL,
    "catalog_paths": catalog_paths_sql(False),
    "catalog_paths_dup": catalog_paths_sql(True),
    "registry_raw": REGISTRY_RAW_SQL,
    "vct_names": VCT_NAMES_SQL,
}
