"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, sharding.

Each stage is a function of (spark, docs, sf_dir) on the documents that its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytotide.llm import decontaminate, langid, mixing, sharding, simhash
from cytotide.llm.common import DOCUMENT_COLUMNS, ready, table
from cytotide.session import checkpoint_dir

#: SQL can't express the language model of the first stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told, with that language; null texts and texts without a letter go."""
    ready(spark)
    found = langid.predict(docs, *langid.learn(docs), *DOCUMENT_COLUMNS)
    return (found.where(F.col("lang_pred") != langid.UNDETERMINED).withColumn("lang", F.col("lang_pred"))
            .select(*DOCUMENT_COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: three-word shingles, at most 2 differing bits.

    The one with the least doc_id stays, null last, of these the least row by a hash of all columns; one of repeated
    rows. Null texts and texts without a word are copies of one another. An empty table stays empty."""
    ready(spark)
    return simhash.one_of_each(docs, DOCUMENT_COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty documents, and all where the benchmark is empty or has only null and empty items, stay; repeated
    rows stay or go together. An empty table stays empty."""
    ready(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with source weights 5, 2, 1: a row for each copy that it takes.

    A null source is a source of its own, the last; documents without words (null texts too) take no part of a budget,
    and a copy that a budget ends in has its first words only. Keys that tie are ordered by doc_id and size. An empty
    table stays empty."""
    ready(spark)
    return mixing.mixed_copies(docs, DOCUMENT_COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard (0 to 15) and slot.

    Null and empty texts have size 1; equal texts lie next to each other, ordered by doc_id (null first), and repeated
    rows take slots of their own. An empty table stays empty."""
    ready(spark)
    placed = sharding.range_shard(sharding.shard_rows(docs, *DOCUMENT_COLUMNS))
    return placed.select(*DOCUMENT_COLUMNS, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("leaks", drop_leaks),
          ("mix", mix_sources), ("shards", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is written to the
    shared checkpoint folder and read again by the next; the last is returned."""
    ready(spark)
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
