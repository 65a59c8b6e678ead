"""Parquet scans.

Column selection and WHERE text are handed to Spark lazily, so Catalyst
prunes the ReadSchema and pushes the predicate into the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytotide.functions.columns import cruise_from_file
from cytotide.functions.numeric import nulls_for_nans
from cytotide.functions.time import as_utc_timestamp


def scan_parquet(spark: SparkSession, path, columns=None, where: str | Column | None = None,
                 with_cruise: bool = False) -> DataFrame:
    """S3: ``SELECT columns FROM parquet(path) WHERE where`` (``*`` by default).

    ``path`` may be a file, a directory or a list of them. ``with_cruise``
    adds the cruise key parsed from each row's file name.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else list(path)))
    if with_cruise:
        df = df.withColumn("cruise", cruise_from_file(F.col("_metadata.file_path")))
    if where is not None:
        df = df.where(F.expr(where) if isinstance(where, str) else where)
    if columns:
        cols = list(columns) + (["cruise"] if with_cruise and "cruise" not in columns else [])
        df = df.select(*cols)
    return df


def bead_sample(df: DataFrame) -> DataFrame:
    """Bead EVT sample rows: ``date`` -> ``time`` (UTC instant), ``file_id`` dropped."""
    out = df.withColumnRenamed("date", "time").drop("file_id")
    out = out.withColumn("time", as_utc_timestamp("time"))
    return nulls_for_nans(out)


def grid_bins(spark: SparkSession, path, with_cruise: bool = True) -> DataFrame:
    """Grid-bin table with its **1-based row position** ``idx`` per file
    (the gridded coordinates address bins by position)."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else list(path)))
    out = df.withColumn("idx", F.col("_metadata.row_index") + F.lit(1))
    if with_cruise:
        out = out.withColumn("cruise", cruise_from_file(F.col("_metadata.file_path")))
    return out


def read_gridded(spark: SparkSession, path, with_cruise: bool = True) -> DataFrame:
    """Hourly gridded counts; ``date`` as UTC instant."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else list(path)))
    if with_cruise:
        df = df.withColumn("cruise", cruise_from_file(F.col("_metadata.file_path")))
    return df.withColumn("date", as_utc_timestamp("date"))
