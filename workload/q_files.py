"""Queries over configuration and file listings (registry, catalog, VCT names, scans)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cytotide.session import checkpoint_dir
from cytotide.sources import (ambiguous_vct_hours, bead_sample, build_catalog, classify_files, default_variation, duplicate_files,
                              normalize_registry, read_window, scan_parquet, vct_file_hour, zone_map, zone_range)
from workload import standins as S
from workload.registry import register

CLASSIFY_SQL = r"""cls AS (
  SELECT name, "default", dir, kind, regexp_replace(base, '\..*$', '') AS cruise, path AS item FROM (
    SELECT *, CASE WHEN regexp_matches(base, '\.outlier\.db$') THEN 'outlier_db'
                   WHEN regexp_matches(base, '\.beads-sample-.*\.parquet$') THEN 'bead_file'
                   WHEN regexp_matches(path, '/grid/.*\.grid_bins\.parquet$') THEN 'grid_file'
                   WHEN regexp_matches(path, '/grid/.*\.hourly_gridded\.parquet$') THEN 'gridded_file' END AS kind
    FROM (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM {src}))
  WHERE kind IS NOT NULL
  UNION ALL
  SELECT DISTINCT name, "default", dir, 'vct_dir' AS kind,
         regexp_replace(regexp_extract(anc, '[^/]*$'), '_(opp|vct)$', '') AS cruise, anc AS item
  FROM (SELECT name, "default", dir,
               unnest(list_transform(range(2, len(string_split(path, '/'))),
                                     lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS anc
        FROM {src})
  WHERE regexp_matches(regexp_extract(anc, '[^/]*$'), '_vct$'))"""

CATALOG_SQL = """cat AS (
  SELECT name, "default", cruise,
         max(CASE WHEN kind = 'outlier_db' THEN item END) AS outlier_db,
         max(CASE WHEN kind = 'bead_file' THEN item END) AS bead_file,
         max(CASE WHEN kind = 'vct_dir' THEN item END) AS vct_dir,
         max(CASE WHEN kind = 'grid_file' THEN item END) AS grid_file,
         max(CASE WHEN kind = 'gridded_file' THEN item END) AS gridded_file
  FROM cls WHERE name IN (SELECT name FROM cls WHERE kind IN ('outlier_db', 'bead_file', 'vct_dir'))
  GROUP BY name, "default", cruise)"""


def _catalog(spark, sf):
    return build_catalog(classify_files(S.catalog_paths(spark, sf)))


@register("registry", """
SELECT trim(name) AS name, trim(dir) AS dir,
       coalesce(lower(trim("default")) IN ('true', 't', '1', 'yes', 'y'), false) AS "default"
FROM registry_raw""")
def q_registry(spark, sf):
    """Registry rows with the text 'default' flag normalised to boolean."""
    return normalize_registry(S.registry_raw(spark, sf))


@register("catalog", "WITH " + CLASSIFY_SQL.format(src="catalog_paths") + ", " + CATALOG_SQL
          + " SELECT * FROM cat")
def q_catalog(spark, sf):
    """S11 + S12 + J3 (T2): listed paths classified by kind and cruise, one row
    per (data set, cruise); a data set with grid files only has no rows."""
    return _catalog(spark, sf)


@register("duplicate_files", "WITH " + CLASSIFY_SQL.format(src="catalog_paths_dup") + """,
g AS (SELECT name, kind, cruise, count(*) AS n FROM cls GROUP BY ALL HAVING count(*) > 1)
SELECT c.*, g.n FROM cls c JOIN g USING (name, kind, cruise)""")
def q_duplicate_files(spark, sf):
    """Files whose (data set, kind, cruise) is not unique."""
    return duplicate_files(classify_files(S.catalog_paths(spark, sf, dup=True)))


@register("default_variation", "WITH " + CLASSIFY_SQL.format(src="catalog_paths") + ", " + CATALOG_SQL + """
SELECT cruise, name AS variation FROM (
  SELECT cruise, name, row_number() OVER (PARTITION BY cruise ORDER BY "default" DESC, name) AS rn
  FROM (SELECT DISTINCT cruise, name, "default" FROM cat WHERE outlier_db IS NOT NULL))
WHERE rn = 1""")
def q_default_variation(spark, sf):
    """O2: per cruise, the default data set with a database, else the first one."""
    return default_variation(_catalog(spark, sf))


VCT_HOUR_SQL = r"""vh AS (
  SELECT file_no, cruise_no, path,
         CASE WHEN regexp_matches(b, '^(.+T\d{2})-(\d{2})-(\d{2})([+-]\d{2})-(\d{2})$') THEN
                try_strptime(substr(b, 1, length(b) - 6), '%Y-%m-%dT%H-%M-%S')
                - (CASE WHEN substr(b, length(b) - 5, 1) = '-' THEN -1 ELSE 1 END)
                  * (to_hours(CAST(substr(b, length(b) - 4, 2) AS INTEGER))
                     + to_minutes(CAST(substr(b, length(b) - 1, 2) AS INTEGER)))
              WHEN regexp_matches(b, '^(.+T\d{2})-(\d{2})-(\d{2})$') THEN try_strptime(b, '%Y-%m-%dT%H-%M-%S')
         END AS file_hour
  FROM (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '\..*$', '') AS b FROM vct_names))"""


@register("vct_file_hour", "WITH " + VCT_HOUR_SQL + " SELECT file_no, path, file_hour FROM vh")
def q_vct_file_hour(spark, sf):
    """UTC hour parsed from each VCT file name (offsets honoured, junk -> NULL)."""
    n = S.vct_names(spark, sf)
    return n.select("file_no", "path", vct_file_hour(F.col("path")).alias("file_hour"))


@register("vct_ambiguous_hours", "WITH " + VCT_HOUR_SQL + """
SELECT cruise_no AS cruise, file_hour, count(*) AS n_files FROM vh WHERE file_hour IS NOT NULL
GROUP BY cruise_no, file_hour HAVING count(*) > 1""")
def q_vct_ambiguous_hours(spark, sf):
    """Hours served by more than one VCT file, per cruise."""
    n = S.vct_names(spark, sf).withColumnRenamed("cruise_no", "cruise")
    return ambiguous_vct_hours(n)


@register("scan_parquet", """
SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem WHERE l_quantity > 45""")
def q_scan_parquet(spark, sf):
    """S3: projected, filtered Parquet scan (pushdown and pruning by Catalyst)."""
    return scan_parquet(spark, f"{sf}/lineitem.parquet", columns=["l_orderkey", "l_quantity", "l_shipdate"],
                        where="l_quantity > 45")


_BEAD_FILES: dict[tuple, str] = {}
BEAD_COLUMNS = ("date", "fsc_small", "chl_small", "pe", "D1", "D2")


def _bead_files(spark, sf):
    """The bead sample as Parquet files that follow one another in time, with times whose extent footers tell."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BEAD_FILES:
        folder, conf = f"{checkpoint_dir(spark)}/beads-{uuid.uuid4().hex}", "spark.sql.parquet.outputTimestampType"
        before = spark.conf.get(conf)
        spark.conf.set(conf, "TIMESTAMP_MICROS")
        try:
            S.beads_raw(spark, sf).repartitionByRange("date").write.parquet(folder)
        finally:
            spark.conf.set(conf, before)
        _BEAD_FILES[key] = folder
    return _BEAD_FILES[key]


@register("zone_extents", """
SELECT min(time) AS date_min, max(time) AS date_max, min(fsc_small) AS fsc_small_min, max(fsc_small) AS fsc_small_max,
       min(chl_small) AS chl_small_min, max(chl_small) AS chl_small_max,
       min(CASE WHEN NOT isnan(pe) THEN pe END) AS pe_min, max(CASE WHEN NOT isnan(pe) THEN pe END) AS pe_max,
       min(D1) AS "D1_min", max(D1) AS "D1_max", min(D2) AS "D2_min", max(D2) AS "D2_max" FROM bead""")
def q_zone_extents(spark, sf):
    """A3, A9 from footers: the extents of time and all channels of the bead files; only what a footer doesn't tell is scanned."""
    return zone_range(spark, zone_map(spark, _bead_files(spark, sf), BEAD_COLUMNS), BEAD_COLUMNS)


@register("zone_window", "SELECT * FROM bead WHERE time >= TIMESTAMP '1997-03-01' AND time < TIMESTAMP '1997-04-15'")
def q_zone_window(spark, sf):
    """P7 through a zone map: bead events of six weeks, from the files that may hold some."""
    start, end = (F.lit(t).cast("timestamp") for t in ("1997-03-01", "1997-04-15"))
    return bead_sample(read_window(spark, zone_map(spark, _bead_files(spark, sf), ["date"]), "date", start, end))
