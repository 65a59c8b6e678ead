"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytotide.llm import ann, decontaminate, html, jaccard, langid, lexical, mixing, quality, repair, sharding, simhash, substring, urls
from cytotide.llm.common import pick, ready, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it contains at least 0.8 of the five-word shingles."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents whose checksum isn't held out."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumn(
        "held_out", F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2)
    model = langid.learn(docs.where("held_out is distinct from true"))
    found = langid.predict(docs, *model, "doc_id", "held_out", "text")
    return found.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score", "proportions")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with source weights 5, 2, 1 takes of every document."""
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that 20-word windows cover which also start earlier."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every vector whose id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of documents whose checksum isn't held out."""
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: (action, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    judged = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document: three-word shingles, at most 2 differing bits."""
    found = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard (0 to 15) and slot, by sampled splitters; shards near equal in bytes."""
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"))
    placed = sharding.range_shard(rows.select("doc_id", "k1", "k2", "size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents of every benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text's digest of every conversation, damaged by its rows' checksums."""
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), F.col("copies"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct five-word shingles and class of every document; similarity 0.8 links."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


_QUERIES = (op1_decontaminate, op2_html_text, op3_language, op4_mix_sources, op5_substrings, op6_nearest, op7_quality,
            op8_url_filter, op9_simhash, op10_range_shards,
            op11_lexical_search, op12_repair, op13_jaccard_join)


def _readied(query: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return query(spark, sf_dir)
    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _readied(q) for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from cytotide.llm.oracles import ORACLES
    return dict(ORACLES)
