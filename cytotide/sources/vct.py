"""Hourly VCT Parquet directories.

A VCT directory holds one Parquet file per hour, named
``<yyyy-mm-ddThh-mm-ss±hh-mm>.<...>.vct.parquet``. ``read_vct`` scans the
whole directory at once (every hour), attaching each row's file hour; the
optional ``at=`` selection becomes a filter on the file name metadata, so
Spark opens only the matching file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytotide.functions.columns import QUANTILE, REFRAC, cruise_from_folder, quantile_tag
from cytotide.functions.numeric import nulls_for_nans
from cytotide.functions.time import as_utc_timestamp
from cytotide.operators.filters import hour_bounds, in_range
from cytotide.sources.files import has_files

# Fixed values from the reference: the file-name time stamp shapes.
VCT_NAME_WITH_OFFSET = r"^(.+T\d{2})-(\d{2})-(\d{2})([+-]\d{2})-(\d{2})$"
VCT_NAME_WITHOUT_OFFSET = r"^(.+T\d{2})-(\d{2})-(\d{2})$"
VCT_FILE_GLOB = "*.vct.parquet"

#: Columns of ``read_vct``, in its order.
VCT_SCHEMA = ("file_hour timestamp, cruise string, time timestamp, pop string, D1 double, D2 double, fsc_small double, "
              "chl_small double, pe double, diameter double, qc double, filter_id double, gating_id double")


def vct_file_hour(name: Column) -> Column:
    """File name -> UTC timestamp of its hour, NULL if unparseable.

    Text before the first dot; ``…Thh-mm-ss±hh-mm`` becomes RFC 3339
    ``…Thh:mm:ss±hh:mm``. Names without an offset are read as UTC.
    """
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\..*$", "")
    rfc = F.when(base.rlike(VCT_NAME_WITH_OFFSET),
                 F.regexp_replace(base, VCT_NAME_WITH_OFFSET, "$1:$2:$3$4:$5")) \
        .when(base.rlike(VCT_NAME_WITHOUT_OFFSET),
              F.regexp_replace(base, VCT_NAME_WITHOUT_OFFSET, "$1:$2:$3"))
    return F.try_to_timestamp(rfc)


def vct_columns(df: DataFrame, quantile: float = QUANTILE, refrac: str = REFRAC,
                keys=()) -> DataFrame:
    """S7 projection: rows with ``q{Q} = TRUE`` and the eleven renamed columns."""
    q = quantile_tag(quantile)
    out = df.where(F.col(f"q{q}") == F.lit(True)).select(
        *keys,
        as_utc_timestamp("date").alias("time"),
        F.col(f"pop_q{q}").alias("pop"),
        "D1", "D2", "fsc_small", "chl_small", "pe",
        F.col(f"diam_{refrac}_q{q}").alias("diameter"),
        F.col(f"Qc_{refrac}_q{q}").alias("qc"),
        "filter_id", "gating_id")
    return nulls_for_nans(out)


def empty_vct(spark: SparkSession) -> DataFrame:
    """Typed empty VCT frame (the reference's answer when no file matches)."""
    return spark.createDataFrame([], VCT_SCHEMA)


def read_vct(spark: SparkSession, path, quantile: float = QUANTILE, refrac: str = REFRAC,
             at=None, between=None) -> DataFrame:
    """S7 + S10: every hourly VCT file under ``path`` (one or many ``*_vct``
    directories), with ``file_hour`` and ``cruise``.

    Folders that are missing or hold no VCT file add nothing; without any file
    the result is a typed empty frame. Other read errors are raised. ``at``
    keeps only the file whose hour equals the UTC hour of ``at`` exactly (file
    pruning on ``_metadata.file_name``); two files of a cruise for that hour
    raise ``ValueError``, as in the reference (``ambiguous_vct_hours`` lists them for all hours).
    ``between=(start, end)`` keeps rows with a time in [start, end), from the files of the hours
    that have a part in it; files whose name tells no hour are not opened, either.
    """
    paths = [p for p in ([path] if isinstance(path, str) else path) if has_files(spark, p, VCT_FILE_GLOB)]
    if not paths:
        return empty_vct(spark)
    raw = spark.read.option("pathGlobFilter", VCT_FILE_GLOB).parquet(*paths)
    raw = raw.withColumns({
        "file_hour": vct_file_hour(F.col("_metadata.file_name")),
        "cruise": cruise_from_folder(F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "")),
    })
    if at is not None:
        start, _ = hour_bounds(at)
        hour = F.lit(start.isoformat(sep=" ")).cast("timestamp")
        twice = ambiguous_vct_hours(vct_files(spark, paths)).where(F.col("file_hour") == hour).collect()
        if twice:
            raise ValueError(f"more than one VCT file for {start}: " + ", ".join(f"{r.cruise} ({r.n_files})" for r in twice))
        raw = raw.where(F.col("file_hour") == hour)
    if between is None:
        return vct_columns(raw, quantile, refrac, keys=("file_hour", "cruise"))
    first, last = (F.lit(hour_bounds(b)[0].isoformat(sep=" ")).cast("timestamp") for b in between)
    raw = raw.where(F.col("file_hour").between(first, last))
    return in_range(vct_columns(raw, quantile, refrac, keys=("file_hour", "cruise")), *between)


def vct_files(spark: SparkSession, path) -> DataFrame:
    """File listing of VCT directories: ``path``, ``cruise``, ``file_hour`` (contents not read)."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", VCT_FILE_GLOB) \
        .option("recursiveFileLookup", "true").load(*paths).select("path")
    return files.withColumns({
        "cruise": cruise_from_folder(F.regexp_replace("path", r"/[^/]*$", "")),
        "file_hour": vct_file_hour(F.col("path")),
    })


def ambiguous_vct_hours(files: DataFrame, name: str = "path", by=("cruise",)) -> DataFrame:
    """Hours matched by more than one VCT file (per cruise), with the count.

    Unparseable names (NULL hour) never match an hour and are ignored.
    """
    by = [k for k in by if k in files.columns]
    hours = files.withColumn("file_hour", vct_file_hour(F.col(name))) \
        .where(F.col("file_hour").isNotNull())
    return hours.groupBy(*by, "file_hour").agg(F.count(F.lit(1)).alias("n_files")) \
        .where(F.col("n_files") > 1)
