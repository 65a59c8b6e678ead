"""Queries over hourly gridded counts and grid bins (decode, scatter, ridgeline)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytotide.functions.numeric import equivalent_diameter
from cytotide.operators import at_time, decode_bins, extent, in_range, populations, value_range
from cytotide.plans import gridded_scatter, ridgeline_flow, ridgeline_series
from workload import standins as S
from workload.registry import register

# The reference's default population selection (A8), computed from the data.
POPS_SQL = """(SELECT pop FROM (SELECT DISTINCT pop FROM gridded_raw WHERE pop IS NOT NULL)
              WHERE pop <> 'unknown' OR (SELECT count(*) FROM gridded_raw WHERE pop <> 'unknown') = 0)"""


def _decoded(spark, sf):
    return decode_bins(S.gridded_raw(spark, sf), S.grid_bins_raw(spark, sf))


@register("grid_decode", "SELECT * FROM decoded")
def q_grid_decode(spark, sf):
    """J11 + F5: bin coordinates replaced by 1-based bin starts (out of range ->
    NULL), coordinates dropped, equivalent spherical diameter from Qc."""
    return _decoded(spark, sf)


@register("equivalent_diameter", """
SELECT p_partkey, p_retailprice / 100.0::DOUBLE AS Qc,
       round(2.0::DOUBLE * pow(3.0::DOUBLE / (4.0::DOUBLE * pi()) * pow((p_retailprice / 100.0::DOUBLE) / 0.261::DOUBLE,
             1.0::DOUBLE / 0.86::DOUBLE), 1.0::DOUBLE / 3.0::DOUBLE), 5) AS diam
FROM part""")
def q_equivalent_diameter(spark, sf):
    """carbon quota -> equivalent spherical diameter (Qc = retail price / 100)."""
    p = S.table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 100.0).alias("Qc"))
    return p.withColumn("diam", equivalent_diameter("Qc"))


@register("gridded_scatter", f"""WITH s AS (
  SELECT date_trunc('hour', date) AS hour, * FROM decoded
  WHERE pop IN {POPS_SQL} AND fsc_small IS NOT NULL AND NOT isnan(fsc_small) AND chl_small IS NOT NULL
    AND NOT isnan(chl_small) AND pe IS NOT NULL AND NOT isnan(pe) AND n IS NOT NULL
    AND fsc_small > 0 AND chl_small > 0 AND pe > 0),
r AS (SELECT hour, min(n) AS r0, max(n) AS r1 FROM s GROUP BY hour)
SELECT s.*, CASE WHEN r1 = r0 THEN 10.0::DOUBLE ELSE (n - r0) / (r1 - r0) * 15.0::DOUBLE + 3.0::DOUBLE END AS marker_size
FROM s JOIN r USING (hour)""")
def q_gridded_scatter(spark, sf):
    """Q9 (P7, A8 + P4, P8, W4): gridded rows per hour for the 3-D scatter, of
    the default population selection, marker size rescaled to 3..18 per hour."""
    return gridded_scatter(_decoded(spark, sf), pops="default")


RIDGE_SQL = f"""
SELECT date, pop, fsc_small,
       CASE WHEN count(*) FILTER (WHERE n IS NULL) = 0 THEN CAST(sum(n) AS BIGINT) END AS n,
       CASE WHEN count(*) FILTER (WHERE Qc_sum IS NULL) = 0 THEN round(sum(Qc_sum), 2) END AS Qc_sum
FROM decoded WHERE pop IN {POPS_SQL} {{extra}} GROUP BY date, pop, fsc_small"""


def _ridge(spark, sf, **kw):
    out = ridgeline_flow(_decoded(spark, sf), x="fsc_small", pops="default", **kw)
    return out.withColumn("Qc_sum", F.round("Qc_sum", 2))


@register("ridgeline", RIDGE_SQL.format(extra=""))
def q_ridgeline(spark, sf):
    """A2 / Q10 (selected-hour mode for every hour): sums of n and Qc_sum per
    (date, pop, fsc_small); a missing input makes its sum missing."""
    return _ridge(spark, sf)


@register("ridgeline_range", "WITH e AS (SELECT min(date) AS lo, max(date) + INTERVAL 1 HOUR AS hi FROM decoded)"
          + RIDGE_SQL.format(extra="AND date >= (SELECT greatest(TIMESTAMP '1996-01-01', lo) FROM e) "
                                   "AND date < (SELECT least(TIMESTAMP '2030-01-01', hi) FROM e)"))
def q_ridgeline_range(spark, sf):
    """Q10 manual range (A3, F6): a requested range clamped to the data extent."""
    return _ridge(spark, sf, per_hour=False, start="1996-01-01 00:00:00", end="2030-01-01 00:00:00")


@register("ridgeline_series", "WITH rg AS (" + RIDGE_SQL.format(extra="") + """)
SELECT pop, date, list(fsc_small ORDER BY fsc_small) AS x, list(Qc_sum ORDER BY fsc_small) AS height
FROM rg GROUP BY pop, date""")
def q_ridgeline_series(spark, sf):
    """One x-ordered (x, height) series per (pop, date)."""
    return ridgeline_series(_ridge(spark, sf), x="fsc_small", height="Qc_sum")


@register("gridded_extent", "SELECT min(date) AS time_min, max(date) + INTERVAL 1 HOUR AS time_max FROM gridded_raw")
def q_gridded_extent(spark, sf):
    """A3: available gridded time range, end padded by one hour."""
    return extent(S.gridded_raw(spark, sf), time="date", pad_hours=1)


@register("gridded_populations", """
SELECT DISTINCT pop, pop <> 'unknown' OR (SELECT count(*) FROM gridded_raw WHERE pop <> 'unknown') = 0 AS selected
FROM gridded_raw WHERE pop IS NOT NULL""")
def q_gridded_populations(spark, sf):
    """Populations and the default selection (all but 'unknown')."""
    return populations(S.gridded_raw(spark, sf))


@register("channel_ranges", """
SELECT pop, min(fsc_small) AS fsc_small_min, max(fsc_small) AS fsc_small_max,
       min(chl_small) AS chl_small_min, max(chl_small) AS chl_small_max, min(pe) AS pe_min, max(pe) AS pe_max,
       min(Qc) AS Qc_min, max(Qc) AS Qc_max, min(diam) AS diam_min, max(diam) AS diam_max
FROM decoded GROUP BY pop""")
def q_channel_ranges(spark, sf):
    """Value range of each decoded channel per population."""
    return value_range(_decoded(spark, sf), ["fsc_small", "chl_small", "pe", "Qc", "diam"], by=["pop"])


@register("gridded_at_time", "SELECT * FROM decoded WHERE date = TIMESTAMP '1998-06-01 11:00:00'")
def q_gridded_at_time(spark, sf):
    """P5: decoded gridded rows at one exact time point."""
    return at_time(_decoded(spark, sf), "1998-06-01 11:00:00", col="date")


@register("gridded_in_range", """
SELECT * FROM decoded WHERE date >= TIMESTAMP '1998-01-01' AND date < TIMESTAMP '1998-02-01'
  AND pop IN ('prochloro', 'synecho')""")
def q_gridded_in_range(spark, sf):
    """Decoded gridded rows in a half-open window, two populations."""
    return in_range(_decoded(spark, sf), "1998-01-01 00:00:00", "1998-02-01 00:00:00", col="date",
                    pops=["prochloro", "synecho"])


@register("cruise_ridgeline_series", f"""WITH rg AS (
  SELECT cruise, date, pop, fsc_small, CASE WHEN count(*) FILTER (WHERE Qc_sum IS NULL) = 0 THEN round(sum(Qc_sum), 2) END AS Qc_sum
  FROM (SELECT 'C' || CAST(g.Qc_coord % 3 AS VARCHAR) AS cruise, g.date, g.pop, g.Qc_sum, b.fsc_small
        FROM gridded_raw g LEFT JOIN grid_bins_raw b ON g.fsc_small_coord = b.idx WHERE g.pop IN {POPS_SQL}) GROUP BY ALL)
SELECT cruise, pop, date, list(fsc_small ORDER BY fsc_small) AS x, list(Qc_sum ORDER BY fsc_small) AS height
FROM rg GROUP BY cruise, pop, date""")
def q_cruise_ridgeline_series(spark, sf):
    """A11 + J11 keyed by cruise: the same grid in each, one series per (cruise, pop, date)."""
    cruise = F.concat(F.lit("C"), (F.col("Qc_coord") % 3).cast("string"))
    gridded = S.gridded_raw(spark, sf).withColumn("cruise", cruise)
    bins = S.grid_bins_raw(spark, sf).withColumn("cruise", F.explode(F.array(*[F.lit(f"C{i}") for i in range(3)])))
    sums = ridgeline_flow(decode_bins(gridded, bins, by=["cruise"]), x="fsc_small", by=["cruise"])
    return ridgeline_series(sums.withColumn("Qc_sum", F.round("Qc_sum", 2)), by=["cruise"])
