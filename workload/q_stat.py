"""Queries over Stat / SFL points and the plans acting on them (events world)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytotide.functions.time import floor_hour, parse_time
from cytotide.operators import (active_at, active_in_hour, exclude_flags, extent, flags_present, gate_conflicts,
                                hourly_stat, in_hour, keep_quantile, ordered,
                                sfl_only_count, time_points, to_intervals)
from cytotide.plans import (active_gating, active_polygons, filter_intervals,
                            filter_param_segments, gating_centroids, gating_intervals, gating_outlines,
                            params_at_points, sfl_metrics, stat_metrics)
from cytotide.sources import sfl_series, stat_series
from cytotide.operators.aggregates import HOURLY_MEDIAN_METRICS
from workload import standins as S
from workload.registry import register

R2 = 6  # decimals kept for medians (interpolation order may differ in the last bit)


def _stat(spark, sf):
    return stat_series(S.stat_raw(spark, sf))


def _stat_f(spark, sf):
    return exclude_flags(_stat(spark, sf))


def _sfl(spark, sf):
    return sfl_series(S.sfl_raw(spark, sf))


def _max_sfl_time(spark, sf):
    return _sfl(spark, sf).agg(F.max("time").alias("max_time"))


def _event_intervals(spark, sf):
    return filter_intervals(S.event_filter_plan(spark, sf),
                            keep_quantile(S.filter_params(spark, sf), 50).drop("date"),
                            max_time=_max_sfl_time(spark, sf))


def _gating_intervals(spark, sf):
    return gating_intervals(S.gating_plan(spark, sf), max_time=_max_sfl_time(spark, sf))


# ------------------------------------------------------------------ S4 S5 P3 P4 P10 Q3 Q4

@register("sfl_series", "SELECT * FROM sfl")
def q_sfl_series(spark, sf):
    """SFL rows, lat/lon parsed from text (bad text -> NULL)."""
    return _sfl(spark, sf)


@register("sfl_metrics", "SELECT * FROM sfl_f")
def q_sfl_metrics(spark, sf):
    """Q3 (+ P3): SFL series without flags 1, 2, 3 (NULL flags kept)."""
    return sfl_metrics(S.sfl_raw(spark, sf))


@register("stat_series", "SELECT * FROM stat")
def q_stat_series(spark, sf):
    """S5 + P10: quantile-50 Stat rows, diameter renamed, time parsed."""
    return _stat(spark, sf)


@register("stat_flag_filter", "SELECT * FROM stat_f")
def q_stat_flag_filter(spark, sf):
    """P3 (T1): Stat rows whose flag text is not 1/2/3; NULL flags are kept."""
    return _stat_f(spark, sf)


@register("stat_pop_filter", "SELECT * FROM stat_f WHERE pop IN ('click', 'view')")
def q_stat_pop_filter(spark, sf):
    """Q4 raw + P4: flag-filtered Stat rows of two populations."""
    return stat_metrics(S.stat_raw(spark, sf), pops=["click", "view"])


HOURLY_SQL = f"""
SELECT date_trunc('hour', time) AS time, pop,
       round(median(opp_evt_ratio), {R2}) AS opp_evt_ratio, round(median(abundance), {R2}) AS abundance,
       round(median(fsc_med), {R2}) AS fsc_med, round(median(chl_med), {R2}) AS chl_med,
       round(median(pe_med), {R2}) AS pe_med, round(median(diameter), {R2}) AS diameter,
       CAST(coalesce(sum(n_count), 0) AS BIGINT) AS n_count
FROM stat_f GROUP BY 1, 2"""


def _round_cols(df, cols, digits):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register("hourly_stat", HOURLY_SQL)
def q_hourly_stat(spark, sf):
    """A1 / Q4 hourly: per (hour, pop) medians of six metrics and the count sum."""
    out = stat_metrics(S.stat_raw(spark, sf), hourly=True)
    return _round_cols(out, ["opp_evt_ratio", "abundance", "fsc_med", "chl_med", "pe_med",
                             "diameter"], R2)


@register("time_points", "SELECT DISTINCT time FROM stat_f")
def q_time_points(spark, sf):
    """Distinct Stat time points (time navigator)."""
    return time_points(_stat_f(spark, sf))


@register("stat_in_hour", """SELECT * FROM stat_f
WHERE time >= TIMESTAMP '2024-01-15 12:00:00' AND time < TIMESTAMP '2024-01-15 13:00:00'""")
def q_stat_in_hour(spark, sf):
    """Stat rows of the UTC hour holding the selection 2024-01-15 12:34:56."""
    return in_hour(_stat_f(spark, sf), "2024-01-15 12:34:56")


# ------------------------------------------------------------------ A3 A10 G1 G2 F2

@register("sfl_only_count", """
SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT time FROM sfl EXCEPT SELECT time FROM stat)""")
def q_sfl_only_count(spark, sf):
    """A10 + G1 (Q11): distinct SFL times absent from Stat."""
    return sfl_only_count(_sfl(spark, sf), _stat(spark, sf))


@register("flags_present", """
SELECT DISTINCT CAST(flag AS DOUBLE) AS flag_value, CAST(flag AS VARCHAR) AS flag
FROM (SELECT flag FROM sfl UNION ALL SELECT flag FROM stat) WHERE flag IS NOT NULL""")
def q_flags_present(spark, sf):
    """Distinct flags of SFL and Stat as text."""
    return flags_present(_sfl(spark, sf), _stat(spark, sf))


@register("sfl_extent", "SELECT min(time) AS time_min, max(time) AS time_max FROM sfl_f")
def q_sfl_extent(spark, sf):
    """A3: shared time axis range of the flag-filtered SFL series."""
    return extent(sfl_metrics(S.sfl_raw(spark, sf)))


PARSE_TEXT_SQL = """parse_src AS (
  SELECT event_id,
         CASE event_id % 4 WHEN 0 THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')
                           WHEN 1 THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S')
                           WHEN 2 THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M')
                           ELSE 'bad ' || CAST(event_id AS VARCHAR) END AS txt
  FROM events)"""


def _parse_src(spark, sf):
    e = S.table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    m = F.col("event_id") % 4
    txt = (F.when(m == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
           .when(m == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
           .when(m == 2, F.date_format(ts, "yyyy-MM-dd HH:mm"))
           .otherwise(F.concat(F.lit("bad "), F.col("event_id").cast("string"))))
    return e.select("event_id", txt.alias("txt"))


#: Text shapes of a time, as Spark's date patterns; the events are dealt to them in turn.
TIME_SHAPES = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd'T'HH.mm.ss'Z'", "yyyyMMddHHmmss", "yyyyMMdd HHmmss", "yyyyMMdd'T'HH:mm:ss.SSS",
               "yyyy.M.d H-m-s", "yyyy-MMM-dd hh:mm:ss a", "yy/MM/dd HH:mm:ss", "yyyy MMMM d, HH:mm:ss", "yyyy-MM-dd HH'h'mm'm'ss's'",
               "yyyy-MM-dd HH:mm:ss '+0000'", "dd.MM.yyyy HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyyMMddHHmm", "yyyy-MMM-dd HH'h'mm", "yyyy-MM-dd")


@register("parse_time_shapes", f"""
SELECT event_id, CASE event_id % {len(TIME_SHAPES)} WHEN 4 THEN date_trunc('milliseconds', t) WHEN 11 THEN NULL WHEN 15 THEN NULL
         WHEN 12 THEN date_trunc('minute', t) WHEN 13 THEN date_trunc('minute', t) WHEN 14 THEN date_trunc('minute', t)
         ELSE date_trunc('second', t) END AS time,
       CASE WHEN event_id % {len(TIME_SHAPES)} IN (11, 15) THEN NULL
            ELSE date_trunc('second', t) + to_minutes(CAST(30 * (event_id % 27 - 13) AS INTEGER)) END AS shifted
FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS t FROM events)""")
def q_parse_time_shapes(spark, sf):
    """times in many shapes (separators, compact digits, month names, two-digit years, am and pm), and with offsets."""
    t, k = F.col("ts").cast("timestamp"), F.col("event_id") % len(TIME_SHAPES)
    shape = F.when(k == 0, F.date_format(t, TIME_SHAPES[0]))
    for i, s in enumerate(TIME_SHAPES[1:], 1):
        shape = shape.when(k == i, F.date_format(t, s))
    off = F.abs(F.col("event_id") % 27 - 13) * 30  # the same wall clock, read at an offset against UTC
    sign = F.when(F.col("event_id") % 27 > 13, "-").otherwise("+")
    stamp = F.concat(F.date_format(t, "yyyy/MM/dd HH:mm:ss"), sign, F.lpad(F.floor(off / 60).cast("string"), 2, "0"), F.lpad((off % 60).cast("string"), 2, "0"))
    e = S.table(spark, sf, "events").select("event_id", shape.alias("time"), F.when(~k.isin(11, 15), stamp).alias("shifted"))
    return parse_time(parse_time(e, "time", mode="row"), "shifted", mode="hms")


@register("parse_time_row", "WITH " + PARSE_TEXT_SQL + """
SELECT event_id, txt, coalesce(try_strptime(txt, '%Y-%m-%d %H:%M:%S'), try_strptime(txt, '%Y-%m-%dT%H:%M:%S'),
                               try_strptime(txt, '%Y-%m-%d %H:%M')) AS parsed FROM parse_src""")
def q_parse_time_row(spark, sf):
    """F2 (row mode): text times with seconds, else without seconds; junk -> NULL."""
    return parse_time(_parse_src(spark, sf), "txt", mode="row", out="parsed")


PARSE_COLUMN_SQL = """parsed_both AS (
  SELECT event_id, txt, coalesce(try_strptime(txt, '%Y-%m-%d %H:%M:%S'), try_strptime(txt, '%Y-%m-%dT%H:%M:%S')) AS hms,
         try_strptime(txt, '%Y-%m-%d %H:%M') AS hm FROM parse_src)
SELECT event_id, txt, CASE WHEN (SELECT count(hms) FROM parsed_both) > 0 THEN hms ELSE hm END AS parsed FROM parsed_both"""


@register("parse_time_column", "WITH " + PARSE_TEXT_SQL + ", " + PARSE_COLUMN_SQL)
def q_parse_time_column(spark, sf):
    """F2 (column mode, T7): the minute-only fallback is used only when no value
    of the column parses with seconds — here some do, so minute-only text is NULL."""
    return parse_time(_parse_src(spark, sf), "txt", mode="column", out="parsed")


@register("parse_time_column_minutes", """WITH parse_src AS (
  SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'bad' ELSE strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M') END AS txt
  FROM events), """ + PARSE_COLUMN_SQL)
def q_parse_time_column_minutes(spark, sf):
    """F2 (column mode, T7): no value parses with seconds, so the minute-only parse is used."""
    e = S.table(spark, sf, "events")
    txt = F.when(F.col("event_id") % 4 == 3, "bad").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm"))
    return parse_time(e.select("event_id", txt.alias("txt")), "txt", mode="column", out="parsed")


@register("stat_ordered", "SELECT * FROM stat ORDER BY time NULLS LAST, pop NULLS LAST")
def q_stat_ordered(spark, sf):
    """O1: Stat rows in output order, missing times last."""
    return ordered(_stat(spark, sf), "time", "pop")


# ------------------------------------------------------------------ W1 W2 J1 Q5 J5 W3

@register("filter_intervals", "SELECT * FROM event_ivp")
def q_filter_intervals(spark, sf):
    """W1 + W2 + J1: filter plan as [start, end) intervals (last end capped at
    the last SFL time) with their quantile-50 parameters."""
    return _event_intervals(spark, sf)


@register("filter_param_segments", """
SELECT filter_id, start_date, end_date, param, y_value FROM (
  SELECT filter_id, start_date, end_date, 'beads_fsc_small' AS param, beads_fsc_small AS y_value FROM event_ivp
  UNION ALL SELECT filter_id, start_date, end_date, 'beads_D1', beads_D1 FROM event_ivp
  UNION ALL SELECT filter_id, start_date, end_date, 'beads_D2', beads_D2 FROM event_ivp)
WHERE start_date IS NOT NULL AND end_date IS NOT NULL AND y_value IS NOT NULL""")
def q_filter_param_segments(spark, sf):
    """Q5 (F11, P11): step segments of the three bead-position parameters."""
    return filter_param_segments(_event_intervals(spark, sf))


@register("filter_params_at_points", """
SELECT * EXCLUDE (rn, quantile) FROM (
  SELECT p.time, i.*, row_number() OVER (PARTITION BY p.time ORDER BY i.start_date DESC NULLS LAST) AS rn
  FROM (SELECT DISTINCT time FROM stat_f) p
  LEFT JOIN event_ivp i ON i.start_date <= p.time AND (i.end_date IS NULL OR p.time < i.end_date))
WHERE rn = 1""")
def q_filter_params_at_points(spark, sf):
    """J5 + W3: filter parameters in force at every Stat time point."""
    return params_at_points(_stat_f(spark, sf), _event_intervals(spark, sf).drop("quantile"))


# ------------------------------------------------------------------ J6 D2 Q8 J7

@register("gating_in_hour", """
SELECT h.hour, g.start_date, g.gating_id, g.end_date
FROM (SELECT DISTINCT date_trunc('hour', time) AS hour FROM stat_f) h
JOIN gating_iv g ON g.start_date < h.hour + INTERVAL 1 HOUR AND (g.end_date IS NULL OR g.end_date > h.hour)""")
def q_gating_in_hour(spark, sf):
    """Gating plan intervals overlapping each Stat hour."""
    hours = _stat_f(spark, sf).select(floor_hour("time").alias("hour")).distinct()
    return active_in_hour(hours, _gating_intervals(spark, sf), disjoint=True)


GATING_AT_POINTS = """gating_at AS (
  SELECT p.time, g.start_date, g.gating_id, g.end_date
  FROM (SELECT DISTINCT time FROM stat_f) p
  JOIN gating_iv g ON g.start_date <= p.time AND (g.end_date IS NULL OR p.time < g.end_date))"""


@register("gating_conflicts", """
SELECT time, CAST(count(DISTINCT gating_id) + max(CASE WHEN gating_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_active
FROM (SELECT DISTINCT time FROM stat_f) p JOIN gating_spans g ON g.start_date <= p.time AND p.time < g.end_date GROUP BY time
HAVING count(DISTINCT gating_id) + max(CASE WHEN gating_id IS NULL THEN 1 ELSE 0 END) > 1""")
def q_gating_conflicts(spark, sf):
    """Stat points with more than one active gating id, among overlapping intervals, by a sweep line."""
    return gate_conflicts(_stat_f(spark, sf), S.gating_spans(spark, sf))


@register("active_gating_points", "WITH " + GATING_AT_POINTS + """
SELECT a.time, strftime(a.start_date, '%Y-%m-%dT%H:%M:%SZ') AS start_date, a.gating_id,
       strftime(a.end_date, '%Y-%m-%dT%H:%M:%SZ') AS end_date, g.pop, g.channel1, g.channel2, g.pop_order
FROM gating_at a LEFT JOIN gating g ON a.gating_id = g.id""")
def q_active_gating_points(spark, sf):
    """Q8 point scope (J5, J2, F4): active gating rows at every Stat point."""
    return active_gating(_stat_f(spark, sf), _gating_intervals(spark, sf), S.gating(spark, sf))


@register("active_gating_hours", """
SELECT h.hour, strftime(a.start_date, '%Y-%m-%dT%H:%M:%SZ') AS start_date, a.gating_id,
       strftime(a.end_date, '%Y-%m-%dT%H:%M:%SZ') AS end_date, g.pop, g.channel1, g.channel2, g.pop_order
FROM (SELECT DISTINCT date_trunc('hour', time) AS hour FROM stat_f) h
JOIN gating_iv a ON a.start_date < h.hour + INTERVAL 1 HOUR AND (a.end_date IS NULL OR a.end_date > h.hour)
LEFT JOIN gating g ON a.gating_id = g.id""")
def q_active_gating_hours(spark, sf):
    """Q8 hour scope (J6, J2, F4): gating rows active anywhere in each Stat hour."""
    return active_gating(_stat_f(spark, sf), _gating_intervals(spark, sf), S.gating(spark, sf),
                         scope="hour")


@register("active_polygons", "WITH " + GATING_AT_POINTS + """
SELECT p.*, a.time FROM poly p JOIN (SELECT DISTINCT time, gating_id FROM gating_at) a USING (gating_id)""")
def q_active_polygons(spark, sf):
    """Polygon vertices of the gating ids active at each Stat point."""
    pts = _stat_f(spark, sf).select("time").distinct()
    act = active_at(pts, _gating_intervals(spark, sf), how="inner", disjoint=True, distinct=True)
    return active_polygons(S.poly(spark, sf), act)


# ------------------------------------------------------------------ keyed (several cruises at once)

def _with_cruise(df, key="user_id"):
    """Stand-in cruise key: three cruises, from the user id of each event."""
    return df.withColumn("cruise", F.concat(F.lit("C"), (F.col(key) % 3).cast("string")))


CRUISE_STAT_SQL = """cstat AS (
  SELECT 'C' || CAST(user_id % 3 AS VARCHAR) AS cruise, CAST(ts AS TIMESTAMP) AS time, event_type AS pop,
         value AS abundance, CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 4 END AS INTEGER) AS flag,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS n_count,
         value / 100.0::DOUBLE AS opp_evt_ratio, value * 3.0::DOUBLE AS fsc_med,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 2.0::DOUBLE END AS chl_med,
         value + user_id AS pe_med, sqrt(value) AS diameter
  FROM events WHERE NOT coalesce(CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 4 END AS VARCHAR)
                                 IN ('1', '2', '3'), false)),
cplan AS (
  SELECT 'C' || CAST(user_id % 3 AS VARCHAR) AS cruise, CAST(ts AS TIMESTAMP) AS start_date, user_id // 3 AS filter_id
  FROM events),
cmax AS (SELECT 'C' || CAST(user_id % 3 AS VARCHAR) AS cruise, max(CAST(ts AS TIMESTAMP)) AS max_time
         FROM events GROUP BY 1),
civ AS (
  SELECT s.cruise, s.start_date, s.filter_id,
         CASE WHEN rn = cnt AND end0 IS NULL THEN m.max_time ELSE end0 END AS end_date
  FROM (SELECT cruise, start_date, filter_id,
               lead(start_date) OVER (PARTITION BY cruise ORDER BY start_date ASC NULLS LAST, filter_id ASC NULLS LAST) AS end0,
               row_number() OVER (PARTITION BY cruise ORDER BY start_date ASC NULLS LAST, filter_id ASC NULLS LAST) AS rn,
               count(*) OVER (PARTITION BY cruise) AS cnt
        FROM cplan) s JOIN cmax m USING (cruise))"""


def _cruise_events(spark, sf):
    e = _with_cruise(S.table(spark, sf, "events"))
    stat = S.stat_raw_from(e, keep=["cruise"]).withColumnRenamed("diam_mid_med", "diameter").drop("quantile")
    plan = e.select("cruise", F.col("ts").cast("timestamp").alias("start_date"),
                    F.floor(F.col("user_id") / 3).alias("filter_id"))
    caps = e.groupBy("cruise").agg(F.max(F.col("ts").cast("timestamp")).alias("max_time"))
    return exclude_flags(stat), plan, caps


@register("cruise_hourly_stat", "WITH " + CRUISE_STAT_SQL + f"""
SELECT cruise, date_trunc('hour', time) AS time, pop,
       round(median(opp_evt_ratio), {R2}) AS opp_evt_ratio, round(median(abundance), {R2}) AS abundance,
       round(median(fsc_med), {R2}) AS fsc_med, round(median(chl_med), {R2}) AS chl_med,
       round(median(pe_med), {R2}) AS pe_med, round(median(diameter), {R2}) AS diameter,
       CAST(coalesce(sum(n_count), 0) AS BIGINT) AS n_count
FROM cstat GROUP BY 1, 2, 3""")
def q_cruise_hourly_stat(spark, sf):
    """A1 keyed by cruise: hourly medians and count sums for three cruises at once."""
    stat, _, _ = _cruise_events(spark, sf)
    return _round_cols(hourly_stat(stat, by=["cruise"]), HOURLY_MEDIAN_METRICS, R2)


@register("cruise_filter_at_points", "WITH " + CRUISE_STAT_SQL + """
SELECT cruise, time, start_date, end_date, filter_id FROM (
  SELECT p.cruise, p.time, i.start_date, i.end_date, i.filter_id,
         row_number() OVER (PARTITION BY p.cruise, p.time ORDER BY i.start_date DESC NULLS LAST) AS rn
  FROM (SELECT DISTINCT cruise, time FROM cstat) p
  LEFT JOIN civ i ON i.cruise = p.cruise AND i.start_date <= p.time AND (i.end_date IS NULL OR p.time < i.end_date))
WHERE rn = 1""")
def q_cruise_filter_at_points(spark, sf):
    """W1 + W2 + J5 + W3 keyed by cruise: each cruise's plan (capped at its own
    last time) applied to its own Stat points."""
    stat, plan, caps = _cruise_events(spark, sf)
    iv = to_intervals(plan, by=["cruise"], tiebreak=["filter_id"], max_time=caps)
    return params_at_points(stat, iv, by=["cruise"])


# ------------------------------------------------------------------ colliding ids of several cruises; text and epoch dates

CRUISE_PARAMS_SQL = """cparams AS (
  SELECT 'C' || CAST(p_partkey % 3 AS VARCHAR) AS cruise, p_partkey // 3 AS id, p_retailprice AS beads_D1,
         p_retailprice * 10.0::DOUBLE AS beads_fsc_small, p_retailprice * 2.0::DOUBLE AS beads_D2 FROM part),
civp AS (SELECT i.*, p.beads_D1, p.beads_D2, p.beads_fsc_small FROM civ i
         LEFT JOIN cparams p ON i.cruise = p.cruise AND i.filter_id = p.id)"""


def _cruise_params(spark, sf):
    """Filter parameters whose ids repeat from cruise to cruise."""
    p, price = _with_cruise(S.table(spark, sf, "part"), "p_partkey"), F.col("p_retailprice")
    return p.select("cruise", F.floor(F.col("p_partkey") / 3).alias("id"), price.alias("beads_D1"),
                    (price * 10.0).alias("beads_fsc_small"), (price * 2.0).alias("beads_D2"))


@register("cruise_filter_segments", "WITH " + CRUISE_STAT_SQL + ", " + CRUISE_PARAMS_SQL + """
SELECT cruise, filter_id, start_date, end_date, param, y_value FROM (
  SELECT cruise, filter_id, start_date, end_date, 'beads_fsc_small' AS param, beads_fsc_small AS y_value FROM civp
  UNION ALL SELECT cruise, filter_id, start_date, end_date, 'beads_D1', beads_D1 FROM civp
  UNION ALL SELECT cruise, filter_id, start_date, end_date, 'beads_D2', beads_D2 FROM civp)
WHERE start_date IS NOT NULL AND end_date IS NOT NULL AND y_value IS NOT NULL""")
def q_cruise_filter_segments(spark, sf):
    """Q5 + J1 keyed by cruise, with parameter ids that repeat from cruise to cruise."""
    _, plan, caps = _cruise_events(spark, sf)
    iv = filter_intervals(plan, _cruise_params(spark, sf), max_time=caps, by=["cruise"])
    return filter_param_segments(iv, by=["cruise"])


PLAN_TEXT_SQL = """
SELECT cruise, filter_id, start_date,
       lead(start_date) OVER (PARTITION BY cruise ORDER BY start_date ASC NULLS LAST, filter_id ASC NULLS LAST) AS end_date
FROM (SELECT 'C' || CAST(user_id % 3 AS VARCHAR) AS cruise, user_id // 3 AS filter_id,
             CASE WHEN event_id % 10 = 0 THEN NULL WHEN user_id % 3 = 1 THEN date_trunc('minute', CAST(ts AS TIMESTAMP))
                  ELSE date_trunc('second', CAST(ts AS TIMESTAMP)) END AS start_date FROM events)"""


@register("plan_text_dates", PLAN_TEXT_SQL)
def q_plan_text_dates(spark, sf):
    """F2 on plan dates: one cruise's text has seconds, another's has none (so its minutes count), a third's is ISO; some junk."""
    e, ts = _with_cruise(S.table(spark, sf, "events")), F.col("ts").cast("timestamp")
    text = (F.when(F.col("event_id") % 10 == 0, "unknown").when(F.col("user_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .when(F.col("user_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm"))
            .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    plan = e.select("cruise", F.floor(F.col("user_id") / 3).alias("filter_id"), text.alias("start_date"))
    iv = filter_intervals(plan, _cruise_params(spark, sf).select("cruise", "id").distinct(), by=["cruise"])
    return iv.select("cruise", "filter_id", "start_date", "end_date")


@register("plan_epoch_dates", """
SELECT gating_id, start_date, lead(start_date) OVER (ORDER BY start_date, gating_id) AS end_date
FROM (SELECT user_id % 20 AS gating_id, date_trunc('second', CAST(ts AS TIMESTAMP)) AS start_date FROM events)""")
def q_plan_epoch_dates(spark, sf):
    """F2 on plan dates that are epoch seconds."""
    plan = S.gating_plan(spark, sf).withColumn("start_date", F.unix_seconds("start_date"))
    return gating_intervals(plan)


CRUISE_GATES_SQL = """cgating AS (
  SELECT DISTINCT 'C' || CAST(c_custkey % 3 AS VARCHAR) AS cruise, c_nationkey AS id, lower(c_mktsegment) AS pop,
         CASE WHEN c_custkey % 3 = 1 THEN 'pe' ELSE 'fsc_small' END AS channel1,
         CASE WHEN c_custkey % 3 = 2 THEN 'pe' ELSE 'chl_small' END AS channel2 FROM customer),
cpoly AS (
  SELECT 'C' || CAST(c_custkey % 3 AS VARCHAR) AS cruise, c_nationkey AS gating_id, lower(c_mktsegment) AS pop,
         c_acctbal AS fsc_small, CAST(c_custkey AS DOUBLE) AS chl_small, c_acctbal / 2.0::DOUBLE AS pe FROM customer),
cgiv AS (
  SELECT cruise, gating_id, start_date,
         lead(start_date) OVER (PARTITION BY cruise ORDER BY start_date ASC NULLS LAST, gating_id ASC NULLS LAST) AS end_date
  FROM (SELECT 'C' || CAST(user_id % 3 AS VARCHAR) AS cruise, CAST(ts AS TIMESTAMP) AS start_date, user_id % 20 AS gating_id FROM events)),
cga AS (
  SELECT p.cruise, p.time, g.start_date, g.end_date, g.gating_id FROM (SELECT DISTINCT cruise, time FROM cstat) p
  JOIN cgiv g ON p.cruise = g.cruise AND g.start_date <= p.time AND (g.end_date IS NULL OR p.time < g.end_date))"""


def _cruise_gates(spark, sf):
    """Gating definitions and polygons whose ids repeat from cruise to cruise, drawn on other channels in each."""
    c = _with_cruise(S.table(spark, sf, "customer"), "c_custkey")
    third = F.col("c_custkey") % 3
    gating = c.select("cruise", F.col("c_nationkey").alias("id"), F.lower("c_mktsegment").alias("pop"),
                      F.when(third == 1, "pe").otherwise("fsc_small").alias("channel1"),
                      F.when(third == 2, "pe").otherwise("chl_small").alias("channel2")).distinct()
    poly = c.select("cruise", F.col("c_nationkey").alias("gating_id"), F.lower("c_mktsegment").alias("pop"),
                    F.col("c_acctbal").alias("fsc_small"), F.col("c_custkey").cast("double").alias("chl_small"),
                    (F.col("c_acctbal") / 2.0).alias("pe"))
    return gating, poly


def _cruise_gating_intervals(spark, sf):
    e = _with_cruise(S.table(spark, sf, "events"))
    return gating_intervals(e.select("cruise", F.col("ts").cast("timestamp").alias("start_date"),
                                     (F.col("user_id") % 20).alias("gating_id")), by=["cruise"])


@register("cruise_active_gating", "WITH " + CRUISE_STAT_SQL + ", " + CRUISE_GATES_SQL + """
SELECT a.cruise, a.time, strftime(a.start_date, '%Y-%m-%dT%H:%M:%SZ') AS start_date,
       strftime(a.end_date, '%Y-%m-%dT%H:%M:%SZ') AS end_date, a.gating_id, g.pop, g.channel1, g.channel2
FROM cga a LEFT JOIN cgating g ON a.cruise = g.cruise AND a.gating_id = g.id""")
def q_cruise_active_gating(spark, sf):
    """Q8 + J2 keyed by cruise, with gating ids that repeat from cruise to cruise."""
    stat, _, _ = _cruise_events(spark, sf)
    return active_gating(stat, _cruise_gating_intervals(spark, sf), _cruise_gates(spark, sf)[0], by=["cruise"])


@register("cruise_active_polygons", "WITH " + CRUISE_STAT_SQL + ", " + CRUISE_GATES_SQL + """
SELECT p.*, a.time FROM cpoly p JOIN (SELECT DISTINCT cruise, time, gating_id FROM cga) a USING (cruise, gating_id)""")
def q_cruise_active_polygons(spark, sf):
    """J7 keyed by cruise: polygons of the gating ids active at each of a cruise's points."""
    stat, _, _ = _cruise_events(spark, sf)
    act = active_at(stat.select("cruise", "time").distinct(), _cruise_gating_intervals(spark, sf), by=["cruise"], how="inner",
                    disjoint=True, distinct=True)
    return active_polygons(_cruise_gates(spark, sf)[1], act, by=["cruise"])


@register("cruise_gate_centroids", "WITH " + CRUISE_STAT_SQL + ", " + CRUISE_GATES_SQL + """,
o AS (SELECT p.cruise, p.gating_id, p.pop, g.pair,
             CASE g.pair WHEN 0 THEN p.fsc_small WHEN 1 THEN p.fsc_small ELSE p.chl_small END AS x,
             CASE g.pair WHEN 1 THEN p.chl_small ELSE p.pe END AS y
      FROM cpoly p JOIN (SELECT *, CASE WHEN channel1 || channel2 IN ('fsc_smallpe', 'pefsc_small') THEN 0
                                        WHEN channel1 || channel2 = 'fsc_smallchl_small' THEN 1 ELSE 2 END AS pair FROM cgating) g
        ON p.cruise = g.cruise AND p.gating_id = g.id AND p.pop = g.pop)
SELECT cruise, CASE pair WHEN 0 THEN 'pe vs fsc_small' WHEN 1 THEN 'chl_small vs fsc_small' ELSE 'pe vs chl_small' END AS pair,
       gating_id, pop, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM o GROUP BY ALL""")
def q_cruise_gate_centroids(spark, sf):
    """J8 + A4 keyed by cruise, with gating ids that repeat from cruise to cruise."""
    gating, poly = _cruise_gates(spark, sf)
    return _round_cols(gating_centroids(gating_outlines(gating, poly, by=["cruise"]), by=["cruise"]), ["x", "y"], 6)
