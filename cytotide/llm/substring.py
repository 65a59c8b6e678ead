"""Substring dedup with fixed-block anchors.

A repeat is a run of WINDOW words that also starts earlier in the corpus
(smaller doc_id, or the same document and an earlier start). Every document is
cut into reference blocks of BLOCK words, one every WINDOW - BLOCK + 1 words,
so that each window holds a whole block of its own document. The blocks are
indexed by hash and probed with the rolling BLOCK-word windows of all
documents. A block that nothing else repeats rules out every window that holds
it. The hits are extended: each window whose own blocks were all hit is hashed
as a whole and compared with all others, and the windows found repeated merge
into maximal repeats, which are cut.

Hashes travel packed: one row holds, for one batch of documents and one slice
of the hash space, the sorted hashes as bytes. A content that is frequent
within a batch is sent once for it, so a passage that a third of all documents
share costs one entry per batch. Texts are shuffled once, into buckets of
about BUCKET_BYTES, and only meet the few bytes found for them. Rows whose
doc_id repeats (as a null one may in a third of all rows) are dealt to buckets
by a hash of their text too; what is found for a row goes to its bucket.

Windows are compared by a 64-bit hash of their words' 64-bit hashes (blocks by
32 bits and those of the slice: a false hit only makes a window be compared).

Defined results: words are split at ASCII white space; null texts have none;
documents shorter than a window keep everything; a null doc_id is the
greatest; rows that share a doc_id are ordered by start alone, and a window
that starts at the same place in two of them is the earlier for neither;
repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.llm.common import materialize, pick

WINDOW = 20
BLOCK = 10
STRIDE = WINDOW - BLOCK + 1
#: Text bytes in a bucket, and words whose hashes share a slice.
BUCKET_BYTES = 8 << 20
SLICE_WORDS = 1 << 20
MOST_SLICES = 1 << 20
#: Repeated doc_ids that are told to all tasks; with more, every row is dealt by its text too.
MOST_REPEATED = 1 << 18
NO_ID = 2 ** 63 - 1
_ROLL = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes, by doubling: the run of 2 ** i is two of half its length."""
    have, run, out, size = 1, words, None, 0
    while True:
        if width & have:
            # prepend runs bit by bit: out covers ``size`` words, run covers ``have``
            out = run if out is None else run[:len(words) - (size + have) + 1] * np.uint64(pow(_ROLL, size, 1 << 64)) + out[have:][:len(words) - (size + have) + 1]
            size += have
        if size == width:
            return _mixed(out)
        half = run
        have *= 2
        n = max(0, len(words) - have + 1)
        run = half[:n] * np.uint64(pow(_ROLL, have // 2, 1 << 64)) + half[have // 2:][:n]


def _planes(x: np.ndarray) -> bytes:
    """Values as bytes, all first bytes before all second ones, which packs sorted and small numbers well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _values(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _joined(packed: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([_values(b, kind) for b in packed]) if len(packed) else np.zeros(0, kind)


def bucket_of(doc: np.ndarray, salt: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a row, as the same expression in Spark computes it; a salt above 0 is the bucket and one."""
    return np.where(salt > 0, salt - 1, (doc ^ (doc.view(np.uint64) >> np.uint64(17)).view(np.int64)) % buckets)


class Batch:
    """The windows of a batch of texts: hashes of all words, where texts begin, and rolling hashes inside texts."""

    def __init__(self, docs: np.ndarray, texts: list[str | None], salts: np.ndarray | None = None) -> None:
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        long = [i for i, w in enumerate(split) if len(w) >= WINDOW]
        self.docs = docs[long]
        self.salts = (np.zeros(len(docs), np.int32) if salts is None else salts)[long]
        self.n = np.array([len(split[i]) for i in long], dtype=np.int64)
        flat = [w for i in long for w in split[i]]
        self.words = hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.zeros(0, np.uint64)
        self.starts = np.cumsum(self.n) - self.n
        self.row = np.repeat(np.arange(len(long)), self.n)
        self.place = np.arange(len(self.words)) - np.repeat(self.starts, self.n)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of this width begin that lie inside one text, and their hashes."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        rolled = _rolled(self.words, width)
        at = np.flatnonzero(self.place[:len(rolled)] + width <= self.n[self.row[:len(rolled)]])
        return at, rolled[at]


def _slices(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[a]), slice(a, b)


_ANCHORS = "slice int, probes binary, blocks binary, docs binary, salts binary, numbers binary, known boolean"
_HITS = "bucket int, docs binary, numbers binary"
_FIRSTS = "slice int, bucket int, hashes binary, docs binary, starts binary, shared binary, known boolean"
_REPEATS = "bucket int, docs binary, starts binary, checks binary"
_FOUND = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string"


def _anchor(slices: int):
    """Per batch: rolling BLOCK-word hashes (once each) and the texts' own blocks, by slice."""
    shift = np.uint64(64 - slices.bit_length() + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            batch = Batch(b["doc"].to_numpy(), list(b["text"]), b["salt"].to_numpy())
            at, hashed = batch.windows(BLOCK)
            if not len(at):
                continue
            probes, count = np.unique(hashed, return_counts=True)
            own = batch.place[at] % STRIDE == 0
            block, doc, salt = hashed[own], batch.docs[batch.row[at[own]]], batch.salts[batch.row[at[own]]]
            number = (batch.place[at[own]] // STRIDE).astype(np.int32)
            twice = count[np.searchsorted(probes, block)] > 1
            out = []
            if twice.any():
                out.append((int(doc[0] % slices), b"", b"", _planes(doc[twice]), _planes(salt[twice]), _planes(number[twice]), True))
            block, doc, salt, number = block[~twice], doc[~twice], salt[~twice], number[~twice]
            order = np.argsort(block)
            block, doc, salt, number = block[order], doc[order], salt[order], number[order]
            parts, block_parts = (probes >> shift).astype(np.int64), (block >> shift).astype(np.int64)
            of = dict(_slices(block_parts))
            for part, s in _slices(parts):
                t = of.get(part, slice(0, 0))
                out.append((part, _planes(_short(probes[s], slices)), _planes(_short(block[t], slices)), _planes(doc[t]),
                            _planes(salt[t]), _planes(number[t]), False))
            yield pd.DataFrame(out, columns=["slice", "probes", "blocks", "docs", "salts", "numbers", "known"])

    return run


def _short(h: np.ndarray, slices: int) -> np.ndarray:
    """The 32 bits after those of the slice, big end first so that sorted values pack well."""
    return (h << np.uint64(slices.bit_length() - 1) >> np.uint64(32)).astype(">u4")


def _by_bucket(of: np.ndarray, docs: np.ndarray, *others: np.ndarray) -> list[tuple]:
    """Packed rows (bucket, docs, others) of parallel arrays."""
    order = np.argsort(of, kind="stable")
    return [(b, *(_planes(x[order][s]) for x in (docs, *others))) for b, s in _slices(of[order])]


def _hit(buckets: int):
    """Per slice: the blocks whose hash more than one batch has, or one batch twice."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        fresh = group[~group["known"]]
        probes = np.sort(_joined(fresh["probes"], ">u4").astype(np.uint32))
        again = np.unique(probes[1:][probes[1:] == probes[:-1]])
        blocks = _joined(fresh["blocks"], ">u4").astype(np.uint32)
        at = np.searchsorted(again, blocks)
        hit = again[np.minimum(at, len(again) - 1)] == blocks if len(again) else np.zeros(len(blocks), bool)
        known = group[group["known"]]
        docs = np.concatenate([_joined(fresh["docs"], np.int64)[hit], _joined(known["docs"], np.int64)])
        numbers = np.concatenate([_joined(fresh["numbers"], np.int32)[hit], _joined(known["numbers"], np.int32)])
        salts = np.concatenate([_joined(fresh["salts"], np.int32)[hit], _joined(known["salts"], np.int32)])
        return pd.DataFrame(_by_bucket(bucket_of(docs, salts, buckets), docs, numbers), columns=["bucket", "docs", "numbers"])

    return run


def _extend(slices: int):
    """Per bucket: hashes of the windows whose own blocks were all hit, the first of each content."""
    shift = np.uint64(64 - slices.bit_length() + 1)

    def run(texts: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        names = ["slice", "bucket", "hashes", "docs", "starts", "shared", "known"]
        hit_docs, hit_numbers = _joined(hits["docs"], np.int64), _joined(hits["numbers"], np.int32)
        if not len(hit_docs) or not len(texts):
            return pd.DataFrame([], columns=names)
        order = np.lexsort((hit_numbers, hit_docs))
        hit_docs, hit_numbers = hit_docs[order], hit_numbers[order]
        bucket = int(texts["bucket"].iloc[0])
        mine = texts[np.isin(texts["doc"].to_numpy(), hit_docs)]
        keys, rows_of_key = np.unique(mine["doc"].to_numpy(), return_counts=True)
        batch = Batch(mine["doc"].to_numpy(), list(mine["text"]))
        at, hashed = batch.windows(WINDOW)
        if not len(at):
            return pd.DataFrame([], columns=names)
        # mark hit blocks by row and number, then look at the blocks that each window holds
        room = batch.n // STRIDE + 1
        base = np.cumsum(room) - room
        marked = np.zeros(int(room.sum()), dtype=bool)
        lo, hi = np.searchsorted(hit_docs, batch.docs, "left"), np.searchsorted(hit_docs, batch.docs, "right")
        for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
            numbers = hit_numbers[a:b]
            marked[base[i] + numbers[numbers < room[i]]] = True
        # exactly one block lies inside a window: the first that doesn't begin before it
        good = marked[base[batch.row[at]] - (-batch.place[at] // STRIDE)]
        at, hashed = at[good], hashed[good]
        doc, start = batch.docs[batch.row[at]], batch.place[at].astype(np.int32)
        order = np.lexsort((start, doc, hashed))
        hashed, doc, start = hashed[order], doc[order], start[order]
        out, shared = [], rows_of_key[np.searchsorted(keys, doc)] > 1
        if len(hashed):
            new = np.concatenate([[True], hashed[1:] != hashed[:-1]])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc != doc[lead]) | (start != start[lead])
            if later.any():
                check = np.where(shared[later], hashed[later], np.uint64(0))
                out.append((bucket % slices, bucket, _planes(check), _planes(doc[later]), _planes(start[later]), b"", True))
            hashed, doc, start, shared = hashed[new], doc[new], start[new], shared[new]
            for part, s in _slices((hashed >> shift).astype(np.int64)):
                rest = (hashed[s] << np.uint64(slices.bit_length() - 1)).astype(">u8")
                out.append((part, bucket, _planes(rest), _planes(doc[s]), _planes(start[s]), _planes(shared[s]), False))
        return pd.DataFrame(out, columns=names)

    return run


def _bucket_of_each(packed: pd.DataFrame) -> np.ndarray:
    return np.repeat(packed["bucket"].to_numpy().astype(np.int64), [len(b) // 8 for b in packed["docs"]])


def _compare(slices: int):
    """Per slice: windows whose content also starts earlier."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        fresh, known = group[~group["known"]], group[group["known"]]
        hashed = _joined(fresh["hashes"], ">u8").astype(np.uint64)
        doc, start, shared = _joined(fresh["docs"], np.int64), _joined(fresh["starts"], np.int32), _joined(fresh["shared"], np.bool_)
        order = np.lexsort((start, doc, hashed))
        bucket = _bucket_of_each(fresh)[order]
        hashed, doc, start, shared = hashed[order], doc[order], start[order], shared[order]
        new = np.concatenate([[True], hashed[1:] != hashed[:-1]])[:len(hashed)]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(hashed) else np.zeros(0, np.int64)
        later = (doc != doc[lead]) | (start != start[lead])
        part = np.uint64(group["slice"].iloc[0]) << np.uint64(64 - slices.bit_length() + 1)
        check = np.where(shared, part | hashed >> np.uint64(slices.bit_length() - 1), np.uint64(0))
        docs = np.concatenate([doc[later], _joined(known["docs"], np.int64)])
        starts = np.concatenate([start[later], _joined(known["starts"], np.int32)])
        checks = np.concatenate([check[later], _joined(known["hashes"], np.uint64)])
        of = np.concatenate([bucket[later], _bucket_of_each(known)])
        return pd.DataFrame(_by_bucket(of, docs, starts, checks), columns=["bucket", "docs", "starts", "checks"])

    return run


def _cut(texts: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
    """Per bucket: each text without the words that repeated windows cover."""
    docs, starts, checks = _joined(repeats["docs"], np.int64), _joined(repeats["starts"], np.int32), _joined(repeats["checks"], np.uint64)
    order = np.argsort(docs, kind="stable")
    docs, starts, checks = docs[order], starts[order], checks[order]
    keys = texts["doc"].to_numpy()
    _, at_key, rows_of_key = np.unique(keys, return_inverse=True, return_counts=True)
    shared = rows_of_key[at_key] > 1
    lo, hi = np.searchsorted(docs, keys, "left"), np.searchsorted(docs, keys, "right")
    out = []
    for i, (doc_id, no_id, text) in enumerate(zip(keys.tolist(), texts["no_id"], texts["text"], strict=True)):
        words = (text or "").encode("utf-8", "replace").split()
        at, spans, n = starts[lo[i]:hi[i]], [], len(words)
        if len(at) and shared[i]:
            # rows of this bucket share this doc_id: only windows of this row's own content count
            places, hashed = Batch(keys[i:i + 1], [text]).windows(WINDOW)
            inside = at < len(places)
            at = at[inside][hashed[at[inside]] == checks[lo[i]:hi[i]][inside]]
        if len(at):
            step = np.zeros(n + 1, dtype=np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
            gone = np.concatenate([[0], np.cumsum(step[:-1]) > 0, [0]]).astype(np.int8)
            edges = np.flatnonzero(np.diff(gone))
            spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
            kept, last = [], 0
            for s in spans:
                kept += words[last:s["start"]]
                last = s["end"]
            words = kept + words[last:]
        out.append((None if no_id else doc_id, n, n - len(words), spans, hashlib.sha256(b" ".join(words)).hexdigest()))
    found = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept_sha256"])
    return found.astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, the removed ``spans``
    (word positions, end exclusive) and the hash of the kept words.

    Number of slices and buckets follow the size of the texts, so that what
    one task holds doesn't grow with them.
    """
    d = pick(docs, "doc_id", "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 << int(np.clip(np.ceil(np.log2(max(size / 6 / SLICE_WORDS, 1))), 6, np.log2(MOST_SLICES)))
    buckets = max(64, size // BUCKET_BYTES)
    d = d.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    repeated = materialize(d.groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("salted")).limit(MOST_REPEATED + 1))
    if repeated.count() <= MOST_REPEATED:
        d = d.join(F.broadcast(repeated), "doc", "left")
    else:
        d = d.withColumn("salted", F.lit(True))
    salt = F.pmod(F.xxhash64("doc", "text"), F.lit(buckets)).cast("int") + 1
    d = d.withColumn("salt", F.when(F.col("salted"), salt).otherwise(F.lit(0)))
    plain = F.pmod(F.col("doc").bitwiseXOR(F.shiftrightunsigned("doc", 17)), F.lit(buckets)).cast("int")
    d = d.withColumn("bucket", F.when(F.col("salt") > 0, F.col("salt") - 1).otherwise(plain))
    texts = d.select("bucket", "doc", F.col("doc_id").isNull().alias("no_id"), "text").groupBy("bucket")
    anchors = d.select("doc", "salt", "text").mapInPandas(_anchor(slices), _ANCHORS)
    hits = anchors.groupBy("slice").applyInPandas(_hit(buckets), _HITS)
    firsts = texts.cogroup(hits.groupBy("bucket")).applyInPandas(_extend(slices), _FIRSTS)
    repeats = firsts.groupBy("slice").applyInPandas(_compare(slices), _REPEATS)
    return texts.cogroup(repeats.groupBy("bucket")).applyInPandas(_cut, _FOUND)
