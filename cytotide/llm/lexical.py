"""Ranked lexical search by dense blocked matrix products.

Every item ranks all documents by integer scores: a term's weight times its
impact in the document, summed over the item's terms.

    weight  w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    length  m = 100 - 25 + (25 n N) div L
    impact    = (10^9 tf) div (1000 tf + 12 m)        (below 10^6)

N counts the documents with a term, L all their terms, n one document's, df the
documents that hold the term, tf its occurrences in the document.

Items are dealt to blocks of about BLOCK_BYTES of text; a block's vocabulary is
what the driver and the tasks hold of it. For each block the documents' texts
are read once, and only the terms of the vocabulary are kept, packed in tiles
of at most TILE_DOCS documents. From the tiles come N, L and df; then each tile
of documents meets each tile of items (ITEM_TILE items, and the vocabulary that
these use): impacts times weights, as dense float64 matrices, by BLAS. All
entries are integers, and vocabulary is cut so that weights times 10^6 stay
below 2^53 for every item. So each partial sum is exact in whatever order BLAS
adds; tiles are added up as 64-bit integers. A task keeps each item's k best,
all ties of the k-th included while it compares, then salted and whole
rankings per item follow. No sum is sent but those of a task's k best.

Terms are the maximal runs of letters and digits of ASCII and of anything
beyond ASCII, A-Z lower-cased. Defined results: null and empty texts and texts
without a term score nothing and count nowhere; equal scores are ranked by
ascending doc_id, null last; each row of a repeated document is ranked, and so
are the items of repeated rows, each for itself; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytotide.llm.common import materialize, pick

K = 20
#: Item text in one block; a pass over the documents for each.
BLOCK_BYTES = 4 << 20
TILE_DOCS = 256
TILE_TERMS = 1 << 18
ITEM_TILE = 128
VOCABULARY_TILE = 4096
IMPACT_BOUND = 10 ** 6
#: Greatest sum of an item's weights in one product.
WEIGHT_BOUND = (2 ** 53 - 1) // IMPACT_BOUND
#: Bytes of a text that are split into terms at a time.
CHUNK = 1 << 20
#: Parts in which an item's candidates are ranked before they meet.
SALTS = 64
_TERM = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in chunks."""
    text = text or b""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):  # on to the end of a term
            while end < len(text) and _TERM[text[end]] != 0x20:
                end += 1
        yield text[at:end].translate(_TERM).split()
        at = end


def _blocks(items: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Distinct items with their number of rows, dealt to blocks, and how many blocks there are."""
    d = pick(items, "item_id", "text").where("text is not null").withColumn("item_id", F.col("item_id").cast("long"))
    d = materialize(d.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies")))
    size = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = -(-size // block_bytes)
    return d.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))), n


class Block:
    """Items of one block: their terms as numbers of the block's vocabulary."""

    def __init__(self, rows: list) -> None:
        self.rows = sorted(((r.item_id is None, r.item_id or 0, r.text), r.copies) for r in rows)
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[dict[int, int]] = []
        for (_, _, text), _ in self.rows:
            seen = Counter(t for part in terms(text.encode()) for t in part)
            self.items.append({self.vocabulary.setdefault(t, len(self.vocabulary)): n for t, n in seen.items()})

    def keys(self) -> list[tuple]:
        return [(i, None if none else item_id, copies) for i, ((none, item_id, _), copies) in enumerate(self.rows)]


def item_tiles(items: list[dict[int, int]], weights: list[int], tile: int = ITEM_TILE, bound: int = WEIGHT_BOUND,
               width: int = VOCABULARY_TILE) -> list[tuple[int, int, list[tuple]]]:
    """(first item, items, products) per tile of items; each product is (vocabulary, rows, columns,
    weights), a matrix whose column sums stay within the bound, of at most ``width`` vocabulary terms."""
    out = []
    for at in range(0, len(items), tile):
        layers: list[list[tuple[int, int, int]]] = []
        part = items[at:at + tile]
        for column, held in enumerate(part):
            layer, used = 0, 0
            for term in sorted(held):
                left = held[term] * weights[term]
                while left > 0:
                    if used == bound:
                        layer, used = layer + 1, 0
                    piece = min(left, bound - used)
                    while len(layers) <= layer:
                        layers.append([])
                    layers[layer].append((term, column, piece))
                    left, used = left - piece, used + piece
        products = []
        for layer in layers:
            entries = np.array(layer, dtype=np.int64)
            vocabulary, rows = np.unique(entries[:, 0], return_inverse=True)
            for low in range(0, len(vocabulary), width):
                some = (rows >= low) & (rows < low + width)
                products.append((vocabulary[low:low + width], rows[some] - low, entries[some, 1], entries[some, 2].astype(np.float64)))
        out.append((at, len(part), products))
    return out


# ------------------------------------------------------------------ tiles of documents

_TILES = "ids array<long>, lengths array<long>, ends binary, terms binary, counts binary, n_docs long, n_terms long"
_TILES_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ends", pa.binary()),
                          ("terms", pa.binary()), ("counts", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])


def document_tiles(docs: DataFrame, vocabulary) -> DataFrame:
    """The documents' terms of a (broadcast) vocabulary in tiles, with the numbers of documents and terms read for each."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        tile: dict = {}

        def fresh() -> None:
            tile.update(ids=[], lengths=[], ends=[], terms=[], counts=[], n_docs=0, n_terms=0, size=0)

        def packed() -> pa.RecordBatch:
            join = lambda parts: np.concatenate(parts).tobytes() if parts else b""
            row = {"ids": tile["ids"], "lengths": tile["lengths"], "ends": np.array(tile["ends"], np.int32).tobytes(),
                   "terms": join(tile["terms"]), "counts": join(tile["counts"]), "n_docs": tile["n_docs"], "n_terms": tile["n_terms"]}
            return pa.RecordBatch.from_pylist([row], schema=_TILES_ARROW)

        fresh()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary())
            for i, doc in enumerate(ids):
                n, found = 0, []
                for part in terms(texts[i].as_py()):
                    n += len(part)
                    found += [t for w in part if (t := number(w)) is not None]
                tile["n_docs"] += n > 0
                tile["n_terms"] += n
                if not found:
                    continue
                unique, counts = np.unique(np.array(found, np.int32), return_counts=True)
                tile["ids"].append(doc)
                tile["lengths"].append(n)
                tile["size"] += len(unique)
                tile["ends"].append(tile["size"])
                tile["terms"].append(unique)
                tile["counts"].append(counts.astype(np.int32))
                if len(tile["ids"]) >= TILE_DOCS or tile["size"] >= TILE_TERMS:
                    yield packed()
                    fresh()
        if tile["n_docs"]:
            yield packed()

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(work, _TILES)


def document_frequencies(tiles: DataFrame, size: int) -> dict[int, int]:
    """How many documents hold each term of the vocabulary, by its number; a task sends a number for each term it has."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            for packed in b.column(0).to_pylist():
                df += np.bincount(np.frombuffer(packed, np.int32), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])

    summed = tiles.select("terms").mapInArrow(work, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in summed.collect()}


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Best:
    """Each item's k highest (score, then least doc_id) so far; ids are (is null, id)."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.least = np.ones(items, np.int64)
        self.held = np.zeros((0, 4), np.int64)  # item, score, is null, id

    def add(self, first_item: int, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        """Scores of a tile of documents (rows) for the items from ``first_item`` on."""
        doc, item = np.nonzero(scores >= self.least[first_item:first_item + scores.shape[1]])
        if not len(doc):
            return
        found = np.stack([item + first_item, scores[doc, item], none[doc], ids[doc]], axis=1)
        x = np.concatenate([self.held, found])
        x = x[np.lexsort((x[:, 3], x[:, 2], -x[:, 1], x[:, 0]))]
        starts = np.flatnonzero(np.diff(x[:, 0], prepend=-1))
        place = np.arange(len(x)) - np.repeat(starts, np.diff(starts, append=len(x)))
        last = x[place == self.k - 1]
        self.least[last[:, 0]] = last[:, 1]
        self.held = x[place < self.k]


def tile_scores(tile: tuple, docs: int, rows: np.ndarray, terms_: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Scores (documents x items) of one tile of documents and one of items."""
    _, items, products = tile
    total = np.zeros((docs, items), np.int64)
    for vocabulary, r, c, w in products:
        local = np.full(size, -1, np.int32)
        local[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
        at = local[terms_]
        some = at >= 0
        impact = np.zeros((docs, len(vocabulary)))
        impact[rows[some], at[some]] = values[some]
        weight = np.zeros((len(vocabulary), items))
        weight[r, c] = w
        total += (impact @ weight).astype(np.int64)
    return total


def best_of_tasks(tiles: DataFrame, item_parts, n_items: int, size: int, n: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): each item's k best documents of every task."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_items, k)
        for b in batches:
            for ids, lengths, ends, packed, counts in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if not ids:
                    continue
                ends = np.frombuffer(ends, np.int32)
                per_doc = np.diff(ends, prepend=0)
                m = np.array([75 + 25 * x * n // total for x in lengths], np.int64)
                rows = np.repeat(np.arange(len(ids)), per_doc)
                numbers = np.frombuffer(packed, np.int32)
                values = impacts(np.frombuffer(counts, np.int32).astype(np.int64), m[rows]).astype(np.float64)
                none = np.array([x is None for x in ids])
                known = np.array([x or 0 for x in ids], np.int64)
                for tile in item_parts.value:
                    best.add(tile[0], tile_scores(tile, len(ids), rows, numbers, values, size), none, known)
        x = best.held
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(x[:, 3], mask=x[:, 2] == 1), pa.array(x[:, 1])], schema=schema)

    return tiles.select("ids", "lengths", "ends", "terms", "counts").mapInArrow(work, "item int, doc_id long, score long")


# ------------------------------------------------------------------ operator

def _ranked(found: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    some = (found.withColumn("salt", salt)
            .withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k))
    whole = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return (whole.join(F.broadcast(keys), "item").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
            .select("item_id", "rank", "doc_id", "score"))


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's k highest-scoring documents with a score above 0."""
    spark: SparkSession = docs.sparkSession
    dealt, n_blocks = _blocks(items, block_bytes)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(n_blocks):
        block = Block(dealt.where(F.col("block") == b).collect())  # about BLOCK_BYTES of item text
        size = len(block.vocabulary)
        if not size:
            continue
        tiles = materialize(document_tiles(docs, spark.sparkContext.broadcast(block.vocabulary)))
        n, total = tiles.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not total:
            return out
        df = document_frequencies(tiles, size)
        weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(size)]
        parts = spark.sparkContext.broadcast(item_tiles(block.items, weights))
        keys = spark.createDataFrame(block.keys(), "item int, item_id long, copies long")
        out = out.unionByName(_ranked(best_of_tasks(tiles, parts, len(block.items), size, n, total, k), keys, k))
    return out
