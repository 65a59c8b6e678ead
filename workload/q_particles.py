"""Queries over particle tables (bead EVT sample, hourly VCT) and gating polygons."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cytotide.functions.columns import BEAD_PANEL_CHANNELS, BEAD_PANEL_LABELS, unpivot_panels
from cytotide.functions.time import floor_hour
from cytotide.operators import (active_at, aligned, guide_hlines, guide_segments, guide_vlines,
                                in_hour, keep_quantile, polygons_for_pop, quantile_sets, replicate_quantiles, value_range)
from cytotide.plans import (attach_params, bead_density, filter_intervals, gating_centroids,
                            gating_cytograms, gating_outlines, opp_selection)
from cytotide.plans.flows import GATING_CHANNEL_PAIRS
from cytotide.sources import bead_sample, vct_columns
from workload import standins as S
from workload.registry import register

SQRT3 = "1.7320508075688772"
PANEL_SQL = list(zip(BEAD_PANEL_CHANNELS, BEAD_PANEL_LABELS))
R_LOG = 6  # decimals kept for values computed through log10


def _beads(spark, sf):
    return bead_sample(S.beads_raw(spark, sf))


def _order_intervals(spark, sf):
    cap = _beads(spark, sf).agg(F.max("time").alias("max_time"))
    return filter_intervals(S.order_filter_plan(spark, sf),
                            keep_quantile(S.filter_params(spark, sf), 50).drop("date"),
                            max_time=cap)


def _beads_p(spark, sf):
    return attach_params(_beads(spark, sf), _order_intervals(spark, sf).drop("quantile"))


def _vct(spark, sf):
    return vct_columns(S.vct_raw(spark, sf))


def _long_sql(src: str, keys: str) -> str:
    parts = [f"SELECT {keys}, fsc_small, '{ch}' AS y_var, '{lab}' AS panel, {ch} AS y_value FROM {src}"
             for ch, lab in PANEL_SQL]
    return ("SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE fsc_small IS NOT NULL AND "
            "NOT isnan(fsc_small) AND y_value IS NOT NULL AND NOT isnan(y_value)")


def hex_sql(src: str, keys: list[str], digits: int | None = None, free_y: bool = True) -> str:
    """SQL of the hexagon rule over ``src(keys, panel, fsc_small, y_value)``."""
    k = ", ".join(keys)
    pk = ", ".join(f"p.{c}" for c in keys)
    cx = f"x0 + (i + lattice * 0.5::DOUBLE) * wx"
    cy = f"y0 + (j + lattice * 0.5::DOUBLE) * ({SQRT3} * wy)"
    if digits is not None:
        cx, cy = f"round({cx}, {digits})", f"round({cy}, {digits})"
    of_y = f"{k}, panel" if free_y else k
    return f"""xr AS (SELECT {k}, min(fsc_small) AS x0, max(fsc_small) AS x1 FROM {src} GROUP BY {k}),
yr AS (SELECT {of_y}, min(y_value) AS y0, max(y_value) AS y1 FROM {src} GROUP BY {of_y}),
hx AS (SELECT {pk}, p.panel, xr.x0, yr.y0,
              CASE WHEN xr.x1 > xr.x0 THEN (xr.x1 - xr.x0) / 110.0::DOUBLE ELSE 1.0::DOUBLE END AS wx,
              CASE WHEN yr.y1 > yr.y0 THEN (yr.y1 - yr.y0) / 110.0::DOUBLE ELSE 1.0::DOUBLE END AS wy,
              p.fsc_small AS x, p.y_value AS y
       FROM {src} p JOIN xr USING ({k}) JOIN yr USING ({of_y})),
uv AS (SELECT *, (x - x0) / wx AS u, (y - y0) / ({SQRT3} * wy) AS v FROM hx),
cand AS (SELECT *, floor(u + 0.5::DOUBLE) AS ia, floor(v + 0.5::DOUBLE) AS ja, floor(u) AS ib, floor(v) AS jb FROM uv),
pick AS (SELECT *, ((u - ia) * (u - ia) + 3.0::DOUBLE * ((v - ja) * (v - ja)))
                   <= ((u - ib - 0.5::DOUBLE) * (u - ib - 0.5::DOUBLE) + 3.0::DOUBLE * ((v - jb - 0.5::DOUBLE) * (v - jb - 0.5::DOUBLE))) AS first
         FROM cand),
cells AS (SELECT {k}, panel, CASE WHEN first THEN 0 ELSE 1 END AS lattice,
                 CAST(CASE WHEN first THEN ia ELSE ib END AS BIGINT) AS i,
                 CAST(CASE WHEN first THEN ja ELSE jb END AS BIGINT) AS j, x0, wx, y0, wy FROM pick)
SELECT {k}, panel, lattice, i, j, {cx} AS cx, {cy} AS cy, count(*) AS n
FROM cells GROUP BY {k}, panel, lattice, i, j, x0, wx, y0, wy"""


OPP_PRED = """coalesce((D2 < D1 + width AND D1 < D2 + width)
  AND ((D1 <= notch_small_D1 * fsc_small + offset_small_D1 AND D2 <= notch_small_D2 * fsc_small + offset_small_D2)
    OR (D1 <= notch_large_D1 * fsc_small + offset_large_D1 AND D2 <= notch_large_D2 * fsc_small + offset_large_D2)), false)"""


# ------------------------------------------------------------------ S6 F11 P6 P9

@register("bead_sample", "SELECT * FROM bead")
def q_bead_sample(spark, sf):
    """S6 (+ T9): bead EVT rows, date -> time, file_id dropped, NaN -> NULL."""
    return _beads(spark, sf)


@register("bead_panels", "WITH long AS (" + _long_sql("bead", "time") + ") SELECT * FROM long")
def q_bead_panels(spark, sf):
    """bead rows unpivoted to the four panels, missing values dropped."""
    return unpivot_panels(_beads(spark, sf), keys=["time"])


@register("bead_in_hour", """SELECT * FROM bead
WHERE time >= TIMESTAMP '1998-06-01 11:00:00' AND time < TIMESTAMP '1998-06-01 12:00:00'""")
def q_bead_in_hour(spark, sf):
    """Bead rows of the UTC hour holding the selection 1998-06-01 11:30."""
    return in_hour(_beads(spark, sf), "1998-06-01 11:30:00")


@register("bead_alignment", """
SELECT time, fsc_small, D1, D2, filter_id, width FROM bead_p WHERE D2 < D1 + width AND D1 < D2 + width""")
def q_bead_alignment(spark, sf):
    """J5 + P9: bead rows with the filter width in force at their time, kept
    when D1 and D2 are aligned within that width."""
    b = _beads_p(spark, sf)
    return b.where(aligned("D1", "D2", "width")).select("time", "fsc_small", "D1", "D2", "filter_id",
                                                        "width")


# ------------------------------------------------------------------ Q1 Q6 (A5)

@register("bead_hex_evt", "WITH evt AS (SELECT date_trunc('hour', time) AS hour, * FROM bead_p "
          "WHERE D2 < D1 + width AND D1 < D2 + width), long AS (" + _long_sql("evt", "hour") + "),\n"
          + hex_sql("long", ["hour"]))
def q_bead_hex_evt(spark, sf):
    """Q6 EVT (P9, F11, A5): hexagon counts of aligned bead events per hour and panel."""
    return bead_density(_beads_p(spark, sf), kind="evt")


@register("bead_hex_shared_y", "WITH evt AS (SELECT date_trunc('hour', time) AS hour, * FROM bead_p "
          "WHERE D2 < D1 + width AND D1 < D2 + width), long AS (" + _long_sql("evt", "hour") + "),\n"
          + hex_sql("long", ["hour"], free_y=False))
def q_bead_hex_shared_y(spark, sf):
    """Q6 EVT with one y range for all panels of an hour (fixed facets)."""
    return bead_density(_beads_p(spark, sf), kind="evt", free_y=False)


@register("opp_selection", f"""
SELECT time, fsc_small, D1, D2, filter_id FROM bead_p WHERE {OPP_PRED}""")
def q_opp_selection(spark, sf):
    """Q1 (J5, J12, P9): bead events passing the filter in force at their time."""
    out = opp_selection(_beads(spark, sf), _order_intervals(spark, sf).drop("quantile"))
    return out.select("time", "fsc_small", "D1", "D2", "filter_id")


def _passes(p: str) -> str:
    return re.sub(r"\b(width|(notch|offset)_\w+)\b", rf"{p}.\1", OPP_PRED)


@register("opp_quantile_sets", f"""
WITH filter_params_q AS (SELECT * REPLACE (width * quantile / 50.0::DOUBLE AS width) FROM filter_params),
sets AS (
  SELECT b.time, b.fsc_small, b.D1, b.D2, i.filter_id,
         coalesce(bool_or({_passes('f')}) FILTER (WHERE f.quantile = 2.5), false) AS "q2.5",
         coalesce(bool_or({_passes('f')}) FILTER (WHERE f.quantile = 50), false) AS "q50",
         coalesce(bool_or({_passes('f')}) FILTER (WHERE f.quantile = 97.5), false) AS "q97.5"
  FROM (SELECT *, row_number() OVER () AS rn FROM bead) b
  JOIN order_iv i ON i.start_date <= b.time AND (i.end_date IS NULL OR b.time < i.end_date)
  JOIN filter_params_q f ON f.id = i.filter_id GROUP BY b.rn, b.time, b.fsc_small, b.D1, b.D2, i.filter_id)
SELECT * FROM sets WHERE "q2.5" OR "q50" OR "q97.5" """)
def q_opp_quantile_sets(spark, sf):
    """Q1 + J12: bead events passing the filters of the three quantiles, judged in one pass, a flag for each."""
    beads = _beads(spark, sf)
    params = S.filter_params(spark, sf).drop("date").withColumn("width", F.col("width") * F.col("quantile") / 50.0)
    iv = filter_intervals(S.order_filter_plan(spark, sf), quantile_sets(params), max_time=beads.agg(F.max("time").alias("max_time")))
    out = opp_selection(beads, iv, quantiles=(2.5, 50, 97.5))
    return out.select("time", "fsc_small", "D1", "D2", "filter_id", "`q2.5`", "q50", "`q97.5`")


@register("bead_hex_opp", f"WITH opp AS (SELECT date_trunc('hour', time) AS hour, * FROM bead_p "
          f"WHERE {OPP_PRED}), long AS (" + _long_sql("opp", "hour") + "),\n" + hex_sql("long", ["hour"]))
def q_bead_hex_opp(spark, sf):
    """Q6 derived OPP (Q1 + A5): hexagon counts of filtered bead events."""
    return bead_density(_beads_p(spark, sf), kind="opp")


# ------------------------------------------------------------------ S7 J10 F12 A6

@register("vct_q50", "SELECT * FROM vct")
def q_vct_q50(spark, sf):
    """VCT rows with q50 = TRUE and the eleven renamed columns."""
    return _vct(spark, sf)


def _vct_active(spark, sf):
    iv = _order_intervals(spark, sf).select("start_date", "end_date",
                                            F.col("filter_id").alias("active_filter_id"))
    return attach_params(_vct(spark, sf), iv)


_UNTRANSFORM = ", ".join(
    f"CASE WHEN {c} > 0 THEN log10({c}) / 3.5::DOUBLE * 65536.0::DOUBLE END AS {c}"
    for c in ("D1", "D2", "fsc_small", "chl_small", "pe"))
VCT_ACTIVE_SQL = f"""vct_active AS (
  SELECT v.time, v.pop, v.diameter, v.qc, v.filter_id, v.gating_id, {_UNTRANSFORM.replace('CASE WHEN ', 'CASE WHEN v.')}
  FROM vct v JOIN order_iv i
    ON i.start_date <= v.time AND (i.end_date IS NULL OR v.time < i.end_date)
  WHERE v.filter_id = i.filter_id)"""


@register("vct_untransformed", "WITH " + VCT_ACTIVE_SQL + f"""
SELECT time, pop, filter_id, round(D1, {R_LOG}) AS D1, round(D2, {R_LOG}) AS D2,
       round(fsc_small, {R_LOG}) AS fsc_small, round(chl_small, {R_LOG}) AS chl_small, round(pe, {R_LOG}) AS pe
FROM vct_active""")
def q_vct_untransformed(spark, sf):
    """J10 + F12: VCT rows of the active filter id, channels on the 16-bit log scale."""
    from cytotide.functions.numeric import untransform
    v = _vct_active(spark, sf).where(F.col("filter_id") == F.col("active_filter_id"))
    v = untransform(v, ["D1", "D2", "fsc_small", "chl_small", "pe"])
    return v.select("time", "pop", "filter_id",
                    *[F.round(c, R_LOG).alias(c) for c in ("D1", "D2", "fsc_small", "chl_small", "pe")])


@register("vct_hex_opp", "WITH " + VCT_ACTIVE_SQL + ", va AS (SELECT date_trunc('hour', time) AS hour, * "
          "FROM vct_active), long AS (" + _long_sql("va", "hour") + "),\n" + hex_sql("long", ["hour"], R_LOG))
def q_vct_hex_opp(spark, sf):
    """Q6 true OPP (J10, F12, F11, A5): hexagon counts of VCT rows of the active filter."""
    out = bead_density(_vct_active(spark, sf), kind="vct")
    return out.withColumns({"cx": F.round("cx", R_LOG), "cy": F.round("cy", R_LOG)})


def _cytogram_sql(scope: str = "date_trunc('hour', time)") -> str:
    levels = "'unknown', 'beads', 'prochloro', 'synecho', 'picoeuk', 'croco'"
    parts = []
    for x, y in GATING_CHANNEL_PAIRS:
        parts.append(f"""SELECT scope_time, pop, CAST(least(floor((lx - x0) / CASE WHEN x1 > x0 THEN (x1 - x0) / 140.0::DOUBLE ELSE 1.0::DOUBLE END), 139) AS BIGINT) AS ix,
       CAST(least(floor((ly - y0) / CASE WHEN y1 > y0 THEN (y1 - y0) / 140.0::DOUBLE ELSE 1.0::DOUBLE END), 139) AS BIGINT) AS iy,
       count(*) AS n, '{y} vs {x}' AS pair
FROM (SELECT l.*, r.x0, r.x1, r.y0, r.y1
      FROM (SELECT {scope} AS scope_time, CASE WHEN pop IN ({levels}) THEN pop END AS pop,
                   log10({x}) AS lx, log10({y}) AS ly
            FROM vct WHERE {x} > 0 AND {y} > 0 AND NOT isnan({x}) AND NOT isnan({y})) l
      JOIN (SELECT {scope} AS scope_time, min(log10({x})) AS x0,
                   max(log10({x})) AS x1, min(log10({y})) AS y0, max(log10({y})) AS y1
            FROM vct WHERE {x} > 0 AND {y} > 0 AND NOT isnan({x}) AND NOT isnan({y}) GROUP BY 1) r
      USING (scope_time))
GROUP BY 1, 2, 3, 4""")
    return "\nUNION ALL\n".join(parts)


@register("gating_cytograms", _cytogram_sql())
def q_gating_cytograms(spark, sf):
    """Q7 (A6): log-scale 140-bin counts per population, hour and channel pair."""
    return gating_cytograms(_vct(spark, sf), scope="hour")


@register("gating_cytograms_point", _cytogram_sql("time"))
def q_gating_cytograms_point(spark, sf):
    """Q7 (A6) per time point instead of per hour."""
    return gating_cytograms(_vct(spark, sf), scope="point")


# ------------------------------------------------------------------ J8 A4 J9

def _outline_sql() -> str:
    parts = []
    for x, y in GATING_CHANNEL_PAIRS:
        parts.append(f"""SELECT p.gating_id, p.pop, p.{x} AS x, p.{y} AS y, p.point_order, g.pop_order, '{y} vs {x}' AS pair
FROM poly p JOIN gating g ON p.gating_id = g.id AND p.pop = g.pop
WHERE g.channel1 IS NOT NULL AND g.channel2 IS NOT NULL
  AND ((g.channel1 = '{x}' AND g.channel2 = '{y}') OR (g.channel1 = '{y}' AND g.channel2 = '{x}'))""")
    return "\nUNION ALL\n".join(parts)


@register("gate_outlines", _outline_sql())
def q_gate_outlines(spark, sf):
    """Polygon vertices of the gates drawn on each channel pair."""
    return gating_outlines(S.gating(spark, sf), S.poly(spark, sf))


@register("gate_centroids", "WITH o AS (" + _outline_sql() + """)
SELECT pair, gating_id, pop, pop_order,
       round(avg(x), 6) AS x, round(avg(y), 6) AS y
FROM o GROUP BY pair, gating_id, pop, pop_order""")
def q_gate_centroids(spark, sf):
    """A4: label position (vertex mean) of each gate on each channel pair."""
    out = gating_centroids(gating_outlines(S.gating(spark, sf), S.poly(spark, sf)))
    return out.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@register("polygons_for_pop", "SELECT * FROM poly WHERE pop = 'building'")
def q_polygons_for_pop(spark, sf):
    """Polygon rows of one population across gating ids."""
    return polygons_for_pop(S.poly(spark, sf), "building")


# ------------------------------------------------------------------ Q2 J4 F6 F7

@register("filter_params_replicated", """
SELECT f.* EXCLUDE (quantile), q.quantile FROM fp50 f CROSS JOIN (VALUES (2.5::DOUBLE), (50.0::DOUBLE), (97.5::DOUBLE)) AS q(quantile)""")
def q_filter_params_replicated(spark, sf):
    """Every parameter row once per quantile."""
    return replicate_quantiles(keep_quantile(S.filter_params(spark, sf), 50).drop("date"))


def _fp_by_id(spark, sf):
    return keep_quantile(S.filter_params(spark, sf), 50).withColumnRenamed("id", "filter_id")


@register("guide_vlines", """
SELECT f.id AS filter_id, t.panel, f.beads_fsc_small AS xintercept
FROM fp50 f CROSS JOIN (VALUES ('chl_small vs fsc_small'), ('pe vs fsc_small'), ('D1 vs fsc_small'),
                               ('D2 vs fsc_small')) AS t(panel)
WHERE f.beads_fsc_small IS NOT NULL AND NOT isnan(f.beads_fsc_small)""")
def q_guide_vlines(spark, sf):
    """Q2: vertical bead-position guides in every panel, per filter id."""
    return guide_vlines(_fp_by_id(spark, sf))


@register("guide_hlines", """
SELECT * FROM (SELECT id AS filter_id, 'D1 vs fsc_small' AS panel, beads_D1 AS yintercept FROM fp50
               UNION ALL SELECT id, 'D2 vs fsc_small', beads_D2 FROM fp50)
WHERE yintercept IS NOT NULL AND NOT isnan(yintercept)""")
def q_guide_hlines(spark, sf):
    """Q2: horizontal D1 / D2 bead guides, per filter id."""
    return guide_hlines(_fp_by_id(spark, sf))


def _segments_sql(lines_src: str, keys: str, range_sql: str) -> str:
    return f"""lines AS (
  SELECT {keys}, 'D1 vs fsc_small' AS panel, notch_small_D1 AS m_small, offset_small_D1 AS b_small,
         notch_large_D1 AS m_large, offset_large_D1 AS b_large FROM {lines_src}
  UNION ALL
  SELECT {keys}, 'D2 vs fsc_small', notch_small_D2, offset_small_D2, notch_large_D2, offset_large_D2 FROM {lines_src}),
ok AS (SELECT l.*, {range_sql} FROM lines l
       WHERE isfinite(m_small) AND isfinite(b_small) AND isfinite(m_large) AND isfinite(b_large)),
eq AS (SELECT *, (CASE WHEN abs(m_small) > 1.5e-8::DOUBLE THEN abs(m_small - m_large) / abs(m_small)
                       ELSE abs(m_small - m_large) END) <= 1.5e-8::DOUBLE AS same FROM ok),
sp AS (SELECT *, CASE WHEN same THEN x_min
                      ELSE least(greatest((b_large - b_small) / (m_small - m_large), x_min), x_max) END AS split_x
       FROM eq),
seg AS (SELECT {keys}, panel, 'small' AS line_kind, m_small AS slope, b_small AS intercept, x_min AS x_start, split_x AS x_end FROM sp
        UNION ALL
        SELECT {keys}, panel, 'large', m_large, b_large, split_x, x_max FROM sp)
SELECT *, slope * x_start + intercept AS y_start, slope * x_end + intercept AS y_end
FROM seg WHERE x_end > x_start"""


@register("guide_segments", "WITH fpl AS (SELECT id AS filter_id, * EXCLUDE (id) FROM fp50), "
          + _segments_sql("fpl", "filter_id", "0.0::DOUBLE AS x_min, 65536.0::DOUBLE AS x_max"))
def q_guide_segments(spark, sf):
    """Q2 (F6, F7): small/large filter-line segments on the fixed 0..2^16 axis,
    split at their intersection; nearly parallel lines split at x_min."""
    return guide_segments(_fp_by_id(spark, sf))


@register("guide_segments_data", """WITH hp AS (
  SELECT h.hour, i.* EXCLUDE (start_date, end_date)
  FROM (SELECT DISTINCT date_trunc('hour', time) AS hour FROM bead) h
  JOIN order_ivp i ON i.start_date <= h.hour AND (i.end_date IS NULL OR h.hour < i.end_date)),
long AS (""" + _long_sql("(SELECT date_trunc('hour', time) AS hour, * FROM bead)", "hour") + """),
xr AS (SELECT hour, min(fsc_small) AS x_min, max(fsc_small) AS x_max FROM long GROUP BY hour),
hpr AS (SELECT hp.*, xr.x_min, xr.x_max FROM hp JOIN xr USING (hour)), """
          + _segments_sql("hpr", "hour", "l.x_min, l.x_max").replace(
              "SELECT {keys}".format(keys="hour") + ", 'D1 vs fsc_small' AS panel,",
              "SELECT hour, x_min, x_max, 'D1 vs fsc_small' AS panel,").replace(
              "SELECT hour, 'D2 vs fsc_small', notch_small_D2",
              "SELECT hour, x_min, x_max, 'D2 vs fsc_small', notch_small_D2").replace(
              "SELECT l.*, l.x_min, l.x_max FROM lines l", "SELECT l.* FROM lines l"))
def q_guide_segments_data(spark, sf):
    """Q2 + J4: filter-line segments per hour, using the parameters in force at
    the start of the hour and the hour's bead x range."""
    beads = _beads(spark, sf)
    hours = beads.select(floor_hour("time").alias("hour")).distinct()
    iv = _order_intervals(spark, sf)
    hp = active_at(hours, iv, time="hour", how="inner", disjoint=True).drop("start_date", "end_date")
    long = unpivot_panels(beads.withColumn("hour", floor_hour("time")), keys=["hour"])
    xr = value_range(long, ["fsc_small"], by=["hour"]).withColumnsRenamed(
        {"fsc_small_min": "x_min", "fsc_small_max": "x_max"})
    return guide_segments(hp, keys=["hour"], x_range=xr, range_keys=["hour"])


def _anchors(particles):
    """The selected point of every hour: its middle."""
    return particles.select(floor_hour("time").alias("hour")).distinct() \
        .withColumn("anchor_time", F.col("hour") + F.expr("INTERVAL 30 MINUTES"))


@register("bead_hex_opp_anchored", f"""WITH anc AS (SELECT DISTINCT date_trunc('hour', time) AS hour FROM bead),
ap AS (SELECT a.hour, p.* EXCLUDE (quantile, start_date, end_date)
       FROM anc a LEFT JOIN order_ivp p
         ON p.start_date <= a.hour + INTERVAL 30 MINUTE
        AND (p.end_date IS NULL OR a.hour + INTERVAL 30 MINUTE < p.end_date)),
opp AS (SELECT * FROM (SELECT b.*, ap.* FROM bead b JOIN ap ON date_trunc('hour', b.time) = ap.hour) WHERE {OPP_PRED}),
long AS (""" + _long_sql("opp", "hour") + "),\n" + hex_sql("long", ["hour"]))
def q_bead_hex_opp_anchored(spark, sf):
    """Q6 derived OPP with the filter of each hour's selected point for the whole hour."""
    beads = _beads(spark, sf)
    attached = attach_params(beads, _order_intervals(spark, sf).drop("quantile"), anchors=_anchors(beads))
    return bead_density(attached, kind="opp")


@register("vct_hex_anchored", f"""WITH ap AS (
  SELECT a.hour, i.filter_id AS active_filter_id
  FROM (SELECT DISTINCT date_trunc('hour', time) AS hour FROM vct) a
  LEFT JOIN order_iv i ON i.start_date <= a.hour + INTERVAL 30 MINUTE
                      AND (i.end_date IS NULL OR a.hour + INTERVAL 30 MINUTE < i.end_date)),
va AS (SELECT ap.hour, v.time, {_UNTRANSFORM.replace('CASE WHEN ', 'CASE WHEN v.')}
       FROM vct v JOIN ap ON date_trunc('hour', v.time) = ap.hour WHERE v.filter_id = ap.active_filter_id),
long AS (""" + _long_sql("va", "hour") + "),\n" + hex_sql("long", ["hour"], R_LOG))
def q_vct_hex_anchored(spark, sf):
    """Q6 true OPP (J10) with the filter id of each hour's selected point for the whole hour."""
    vct = _vct(spark, sf)
    iv = _order_intervals(spark, sf).select("start_date", "end_date", F.col("filter_id").alias("active_filter_id"))
    out = bead_density(attach_params(vct, iv, anchors=_anchors(vct)), kind="vct")
    return out.withColumns({"cx": F.round("cx", R_LOG), "cy": F.round("cy", R_LOG)})


@register("opp_selection_anchored", f"""WITH anc AS (SELECT DISTINCT date_trunc('hour', time) AS hour FROM bead),
ap AS (SELECT a.hour, p.* EXCLUDE (quantile, start_date, end_date)
       FROM anc a LEFT JOIN order_ivp p
         ON p.start_date <= a.hour + INTERVAL 30 MINUTE
        AND (p.end_date IS NULL OR a.hour + INTERVAL 30 MINUTE < p.end_date)),
bp AS (SELECT b.*, ap.* EXCLUDE (hour) FROM bead b JOIN ap ON date_trunc('hour', b.time) = ap.hour)
SELECT time, fsc_small, D1, D2, filter_id FROM bp WHERE {OPP_PRED}""")
def q_opp_selection_anchored(spark, sf):
    """Q1 with the reference's anchoring: each hour's particles use the filter
    in force at that hour's selected point (here the mid-hour point), even if
    the plan changes inside the hour."""
    beads = _beads(spark, sf)
    iv = _order_intervals(spark, sf).drop("quantile")
    out = opp_selection(beads, iv, anchor="selected", anchors=_anchors(beads))
    return out.select("time", "fsc_small", "D1", "D2", "filter_id")
