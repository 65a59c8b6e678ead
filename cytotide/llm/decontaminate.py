"""Benchmark decontamination by size-partitioned MinHash containment search.

A document leaks a test item if it contains at least THRESHOLD of the item's
distinct word shingles. Items are partitioned by their number of shingles
(powers of two). Of an item with q shingles, a contained one misses at most
floor((1 - THRESHOLD) q); so at least one of its floor((1 - THRESHOLD) q) + 1
smallest shingle hashes (its MinHash sketch) is in the document. Every
document is therefore probed with those of its shingle hashes that are below
some partition's greatest sketch hash, and an item is a candidate where a
sketch hash is hit and the document is long enough for the item's partition.
That loses nothing. Candidates are verified by exact containment of the
shingles as texts.

Words are lower-cased and split at ASCII white space. Defined results: an
item of fewer words than a shingle is one shingle of all its words, sought at
that length; null and empty items match nothing, and null and empty documents
leak nothing; repeated documents and items are reported for each row (a
repeated item row once); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytotide.llm.common import materialize, pick, sized_broadcast, words

SHINGLE = 5
THRESHOLD = 0.8


def _shingles(ws: Column, n: Column | int) -> Column:
    """Runs of n words as arrays; none where there are fewer words."""
    size = F.size(ws)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(ws, i, n))


def _runs(ws: Column, n: Column | int) -> Column:
    return F.transform(_shingles(ws, n), lambda run: F.array_join(run, " "))


def _word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _hashes(word_hashes: Column, n: Column | int) -> Column:
    """64-bit hashes of the runs of n words, from the words' hashes. These must be a
    column already made, as they are looked up once for each run."""
    return F.transform(_shingles(word_hashes, n), lambda run: F.xxhash64(run))


def _text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def item_shingles(items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per item: its shingle length ``k``, distinct ``shingles``,
    their ``hashes`` in order and number ``n``, how many a match needs, and its size partition."""
    d = pick(items, "item_id", "text").withColumn("ws", words(F.lower("text"))).where(F.size("ws") > 0)
    d = d.withColumn("k", F.least(F.size("ws"), F.lit(shingle)))
    d = d.withColumn("word_hashes", _word_hashes(F.col("ws")))
    d = d.withColumn("hashes", F.array_sort(F.array_distinct(_hashes(F.col("word_hashes"), F.col("k")))))
    d = d.withColumn("shingles", F.array_distinct(_runs(F.col("ws"), F.col("k"))))
    d = d.withColumn("n", F.size("shingles")).withColumn("item_key", _text_key(F.array_join("ws", " ")))
    return (d.withColumn("need", F.ceil(F.col("n") * threshold - 1e-9).cast("int"))
            .withColumn("part", F.floor(F.log2("n")).cast("int"))
            .dropDuplicates(["item_id", "item_key"])
            .select("item_id", "item_key", "k", "hashes", "shingles", "n", "need", "part"))


def sketches(items: DataFrame) -> DataFrame:
    """(k, part, least, hash): the sketch hashes of ``item_shingles`` and the
    fewest shingles that a document must have for the item's partition."""
    taken = F.slice("hashes", 1, F.col("n") - F.col("need") + 1)
    least = items.groupBy("part").agg(F.min("need").alias("least"))
    return items.join(least, "part").select("k", "part", "least", F.explode(taken).alias("hash")).distinct()


def _for_each_length(lengths: list[int], make) -> DataFrame:
    """Union of ``make(k)`` over the items' shingle lengths: one, unless there are items shorter than a shingle."""
    out = make(lengths[0])
    for k in lengths[1:]:
        out = out.unionByName(make(k))
    return out


def leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, item_id, n_item, n_shared, containment) of every document and item it leaks.

    The documents are read three times: for the probes, where only hashes
    leave the scan; for the exact check of candidates' texts; and for the ids
    of the texts found. Sketches and keys are broadcast if their measured size allows.
    """
    items = materialize(item_shingles(items, shingle, threshold))
    sketch = materialize(sketches(items))
    # one row per shingle length, at most ``shingle`` of them
    greatest = dict(sketch.groupBy("k").agg(F.max("hash")).collect())
    d = pick(docs, "doc_id", "text").withColumn("text_key", _text_key(F.col("text")))
    if not greatest:
        return d.limit(0).select("doc_id", "text_key", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
                                 F.lit(0).alias("n_item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment"))
    lengths = sorted(greatest)
    split = d.select("text_key", words(F.lower("text")).alias("ws"))

    hashed = split.select("text_key", _word_hashes(F.col("ws")).alias("word_hashes"))

    def probes(k: int) -> DataFrame:
        low = F.filter(_hashes(F.col("word_hashes"), k), lambda h: h <= F.lit(greatest[k]))
        return hashed.select("text_key", (F.size("word_hashes") - (k - 1)).alias("size"), F.lit(k).alias("k"),
                             F.explode(low).alias("hash"))

    hits = _for_each_length(lengths, probes).join(sized_broadcast(sketch), ["k", "hash"]).where("size >= least")
    candidates = sized_broadcast(hits.select("text_key").distinct())
    texts = split.join(candidates, "text_key", "left_semi")

    def runs(k: int) -> DataFrame:
        return texts.select("text_key", F.lit(k).alias("k"), F.explode(F.array_distinct(_runs(F.col("ws"), k))).alias("shingle"))

    sought = sized_broadcast(items.select("item_id", "item_key", "k", F.col("n").alias("n_item"), "need",
                                          F.explode("shingles").alias("shingle")))
    shared = (_for_each_length(lengths, runs).join(sought, ["k", "shingle"])
              .groupBy("text_key", "item_id", "item_key", "n_item", "need")
              .agg(F.count_distinct("shingle").alias("n_shared")).where("n_shared >= need"))
    matches = sized_broadcast(shared.select("text_key", "item_id", "n_item", "n_shared",
                                            (F.col("n_shared") / F.col("n_item")).alias("containment")))
    return d.select("doc_id", "text_key").join(matches, "text_key")


def clean(docs: DataFrame, items: DataFrame, columns: tuple[str, ...], shingle: int = SHINGLE,
          threshold: float = THRESHOLD) -> DataFrame:
    """The named columns of documents that leak no item."""
    d = pick(docs, *dict.fromkeys((*columns, "text")))
    dirty = sized_broadcast(leaks(d, items, shingle, threshold).select("text_key").distinct())
    return d.withColumn("text_key", _text_key(F.col("text"))).join(dirty, "text_key", "left_anti").select(*columns)
