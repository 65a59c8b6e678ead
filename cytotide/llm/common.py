"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytotide.operators.joins import materialize, sized_broadcast
from cytotide.session import checkpoint_dir, ship_code

__all__ = ["DOCUMENT_COLUMNS", "WORD", "constant", "materialize", "pick", "ready", "sized_broadcast", "table", "word_count",
           "words"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows in one Arrow batch handed to Python: bounds the worker's memory on long texts.
BATCH_ROWS = "1000"


def ready(spark: SparkSession) -> None:
    """Session state the operators need: shared checkpoint folder, UTC, the
    package on the executors' import path, bounded Arrow batches."""
    checkpoint_dir(spark)
    ship_code(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, by exact spelling and first position.

    Inputs may carry extra columns whose names repeat, or differ from ours in
    case only; selecting by name would be ambiguous, so columns are taken by
    position.
    """
    at = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return at.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(words(text)).cast("long")


def constant(spark: SparkSession, value, kind: str) -> Column:
    """A bounded driver-side value (splitters, totals) as one expression: Spark
    evaluates the subquery once and inlines it, whatever its size."""
    return spark.createDataFrame([(value,)], f"v {kind}").coalesce(1).scalar()
