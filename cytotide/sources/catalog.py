"""Data-set registry and file catalog.

The registry is a small CSV (``name, dir, default``). The catalog lists the
files and folders of every data set (``sources.listing``), classifies them by
name, derives the cruise key, and pivots them into one row per (data set,
cruise).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytotide.functions.columns import cruise_key, require_columns
from cytotide.operators.joins import plan_join
from cytotide.sources.listing import list_tree

# Fixed values from the reference.
REGISTRY_COLUMNS = ("name", "dir", "default")
TRUE_WORDS = ("true", "t", "1", "yes", "y")
REGISTRY_ENV = "CYTOTIDE_DATA_SETS_FILE"
REGISTRY_DEFAULT_PATH = os.path.join("config", "data_sets.csv")
# File kinds, in catalog column order, with the name patterns that find them.
KINDS = ("outlier_db", "bead_file", "vct_dir", "grid_file", "gridded_file")
CORE_KINDS = ("outlier_db", "bead_file", "vct_dir")
OUTLIER_DB = r"\.outlier\.db$"
BEAD_FILE = r"\.beads-sample-.*\.parquet$"
VCT_DIR = r"_vct$"
GRID_FILE = r"/grid/.*\.grid_bins\.parquet$"
GRIDDED_FILE = r"/grid/.*\.hourly_gridded\.parquet$"


def normalize_registry(df: DataFrame) -> DataFrame:
    """Keep ``name, dir, default``; ``default`` is true iff its lower-case
    text is one of true/t/1/yes/y (missing -> false). Values are trimmed, as a
    CSV reader with whitespace trimming would."""
    require_columns(df, REGISTRY_COLUMNS, "Data sets config")
    text = F.lower(F.trim(F.col("default").cast("string")))
    keep = ["position"] if "position" in df.columns else []
    return df.select(F.trim("name").alias("name"), F.trim("dir").alias("dir"),
                     F.coalesce(text.isin(list(TRUE_WORDS)), F.lit(False)).alias("default"), *keep)


def read_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Read the registry CSV (all columns as text). The path defaults to
    ``$CYTOTIDE_DATA_SETS_FILE`` or ``config/data_sets.csv``.

    ``position`` keeps the file order (used to pick a default variation).
    """
    path = path or os.environ.get(REGISTRY_ENV, REGISTRY_DEFAULT_PATH)
    if not os.path.exists(path) and "://" not in path:
        raise FileNotFoundError(f"Data sets config not found: {path}")
    raw = spark.read.option("header", "true").csv(path).coalesce(1)
    raw = raw.withColumn("position", F.monotonically_increasing_id())
    return normalize_registry(raw)


def _ancestors(path: Column) -> Column:
    """Every ancestor folder of a file path, as an array of paths."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts) - 1),
                           lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) >= 3, prefixes).otherwise(F.array().cast("array<string>"))


def classify_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """S11 + S12: map listed file paths to ``(kind, item, cruise)``.

    ``item`` is the file itself, or for ``vct_dir`` the ``*_vct`` folder. Folders
    are rows with ``is_dir``, as ``list_tree`` has them; without that column they come from
    the paths of the files they hold. The ``grid`` files must sit under a folder named ``grid``.
    """
    p = F.col(path)
    base = F.element_at(F.split(p, "/"), -1)
    if "is_dir" in paths.columns:
        folders = paths.where("is_dir").drop("is_dir").where(base.rlike(VCT_DIR))
        found = classify_files(paths.where("not is_dir").drop("is_dir"), path).where("kind <> 'vct_dir'")
        folders = folders.withColumn("kind", F.lit("vct_dir")).withColumn("cruise", cruise_key(p, F.col("kind")))
        return found.unionByName(folders.withColumnRenamed(path, "item").select(*found.columns))
    files = paths.withColumn("kind", F.when(base.rlike(OUTLIER_DB), "outlier_db")
                             .when(base.rlike(BEAD_FILE), "bead_file")
                             .when(p.rlike(GRID_FILE), "grid_file")
                             .when(p.rlike(GRIDDED_FILE), "gridded_file"))
    plain = files.where(F.col("kind").isNotNull()).withColumn("item", p) \
        .withColumn("cruise", cruise_key(F.col("item"), F.col("kind")))
    dirs = paths.select(*[c for c in paths.columns if c != path],
                        F.explode(_ancestors(p)).alias("item")) \
        .where(F.element_at(F.split("item", "/"), -1).rlike(VCT_DIR)).distinct()
    if "dir" in paths.columns:  # folders above the data set, and its own, are no cruise
        root = F.concat(F.regexp_replace(F.regexp_replace("dir", r"^file:/*", "/"), r"/+$", ""), F.lit("/"))
        dirs = dirs.where(F.col("item").startswith(root))
    dirs = dirs \
        .withColumn("kind", F.lit("vct_dir")).withColumn("cruise", cruise_key(F.col("item"), F.col("kind")))
    cols = [c for c in paths.columns if c != path] + ["kind", "cruise", "item"]
    return plain.select(*cols).unionByName(dirs.select(*cols))


def list_files(spark: SparkSession, registry: DataFrame) -> DataFrame:
    """Recursive listing of every registered data-set folder, classified.

    The registry is a small config table; all its folders are one scan of the listing source.
    A registered folder that doesn't exist is warned of and adds nothing.
    """
    rows = registry.where("dir is not null and dir <> ''").select("name", "dir", "default")
    roots = [r.dir for r in rows.select("dir").distinct().collect()]  # a config file
    tree = list_tree(spark, roots).withColumn("path", F.regexp_replace("path", r"^file:/*", "/"))
    return classify_files(rows.join(tree, rows["dir"] == tree["root"]).select("name", "default", "dir", "path", "is_dir"))


def duplicate_files(files: DataFrame, keys=("name", "kind", "cruise")) -> DataFrame:
    """Every file row whose (data set, kind, cruise) has more than one
    file, with the group size ``n``. Empty means the catalog is unambiguous."""
    keys = list(keys)
    groups = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return files.join(groups, on=keys, how="inner")


def assert_unique(files: DataFrame, keys=("name", "kind", "cruise")) -> None:
    """D1 as a check: raise ValueError naming all duplicate cruises and paths."""
    found = duplicate_files(files, keys).select(*keys, "item").orderBy(*keys, "item").collect()
    if found:
        detail = "; ".join("/".join(str(r[k]) for k in keys) + f": {r['item']}" for r in found)
        raise ValueError(f"Expected at most one file per cruise and kind, found duplicates: {detail}")


def _only(kind: str) -> Column:
    """The one item of a kind in a group; more than one is an error that lists them."""
    items = F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("item"))))
    said = F.concat(F.lit(f"Expected at most one {kind} per data set and cruise, found "), F.array_join(items, ", "))
    return F.when(F.size(items) > 1, F.raise_error(said).cast("string")).otherwise(F.get(items, F.lit(0))).alias(kind)


def build_catalog(files: DataFrame) -> DataFrame:
    """J3 (+ G4, D1): one row per (data set, default, cruise) with one path
    column per kind — the full outer join of the five per-kind tables, written
    as one grouped pivot. Two files of one kind and cruise stop the job, as in
    the reference. A registered data set (name and folder) without any outlier
    db, bead file or VCT folder contributes no rows, even if it has grid files (T2)."""
    keys = ["name", "default", "cruise"]
    per = [c for c in ("name", "dir") if c in files.columns]
    core = F.max(F.col("kind").isin(list(CORE_KINDS)).cast("int")).alias("__core")
    kept = plan_join(files, files.groupBy(*per).agg(core), per).where(F.col("__core") == 1)
    return kept.groupBy(*keys).agg(*[_only(k) for k in KINDS])


def default_variation(catalog: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """O2: per cruise, the variation to show: among data sets that have an
    outlier db, the first default one, else the first one (registry order,
    ``position``; name order when no registry is given)."""
    have = catalog.where(F.col("outlier_db").isNotNull()).select("cruise", "name", "default").distinct()
    if registry is not None and "position" in registry.columns:
        have = have.join(registry.select("name", "position"), on="name", how="left")
        order = [F.col("default").desc(), F.col("position").asc_nulls_last(), F.col("name")]
    else:
        order = [F.col("default").desc(), F.col("name")]
    # One row per (cruise, data set): bounded by the registry size.
    w = Window.partitionBy("cruise").orderBy(*order)
    return have.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1) \
        .select("cruise", F.col("name").alias("variation"))
