"""N-gram Jaccard join with PartEnum signatures.

Documents are linked if their sets of word shingles have a Jaccard similarity of
at least THRESHOLD. The join finds the links between distinct sets; a
document's class is what its set can reach.

Sets of a similarity of at least t differ by at most (a + b)(1 - t) / (1 + t)
features, a and b being their sizes. Sizes fall into bands; a set signs for its
own band and, where a partner may lie there, for the next. The features of a
band are partitioned by hash.

* Bands of small sets: the signatures are the projections of the set on every
  subset of n - k of the n partitions (k: most differing features). Two similar
  sets differ in at most k partitions, so one subset leaves them all out.
* Other bands: there are more partitions than a pair can differ in, and the
  subsets are single partitions. A set signs the first k + 1 of its partitions
  that aren't empty, and some more, as many for each set of the band. Of the
  first k + 1 of two similar sets, up to where the first of them ends, they
  agree in at least one. A set without k + 1 signs all partitions, empty ones too.

A signature that more than HOT sets share is hot. A set with k + 1 signatures
that aren't hot can do without the others, by the same argument (hot ones count
as empty for both sets, and it has no more of them than any set signs beyond
k + 1); so only the pairs of HOT or fewer sets are looked at there. Sets that
have too few of those (near copies in large groups, texts made of common
passages) are crowded. Of these, sets with too many features that no other one
has are let go, as they can be similar to none. The rest sign anew, with
partitions in groups and subsets of each group, which single passages don't
fill. Crowded sets that such signatures connect are a family, and are compared
with CANDIDATES of them; the one with the most links is the pivot. Those linked to it
need no comparison with one another, and by the triangle inequality only with
others within twice the distance; the rest are families anew. Once the pairs
that are left are few (LISTED for each set of the corpus), or pivots take less
than a tenth of what is left, they are compared one by one. Only classes are
wanted: sets that the links found so far connect aren't compared, and a family that
they connect is done. The sets of a family are dealt to parts, and sketches are tested
as they meet there: only pairs that pass are listed.

Candidates pass a test that loses none (the parities of the features in about
twice as many cells differ in no more than the sets may) and are then verified
on the sets.

Where work grows: signatures travel packed and sorted, about 0.4 for each
feature, dealt to slices of the hash space; of copies in one batch one signs,
and of a signature that is hot within a batch only the fact is sent. Texts are
read three times: for the sets' keys, for the signatures, and for the sets of
candidates.

Features are 64-bit hashes of the shingles, a set's key is 128 bits of its
features. Defined results: words are split at ASCII white space, A-Z
lower-cased; fewer words than a shingle are one feature; null texts and texts
without a word have none and are linked with nothing; a class is named by its
smallest doc_id (null if it has none); repeated rows have the class of their
text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytotide.llm.common import materialize, pick, sized_broadcast
from cytotide.llm.components import components, roots_of
from cytotide.llm.substring import _planes, _values
from cytotide.operators.joins import broadcast_fits

SHINGLE = 5
#: Similarity as a fraction.
THRESHOLD = (80, 100)
#: Sets on one signature, above which they aren't paired.
HOT = 32
#: Bands whose sets differ by at most so many features enumerate subsets of several partitions.
SMALL = 3
LEAST_SKETCH = 1024
#: Partitions in a group of a crowded set's signatures, and how many of them a subset leaves out.
WIDE = (5, 2)
#: Signatures that are sorted at a time, and in one slice.
BATCH_ENTRIES = 1 << 21
SLICE_ENTRIES = 1 << 21
#: Pairs of crowded sets that may be listed for each set of the corpus, pivots of a family after which all that are
#: left are listed, sets of a family that one is chosen from, and measured bytes of pivots and of pairs that are broadcast.
LISTED = 16
ROUNDS = 8
CANDIDATES = 16
#: Times that crowded sets are told which features are theirs alone.
PEELS = 2
#: Sets of a family in one part, about, and most parts of a family.
PART_SETS, PARTS = 512, 64
PIVOT_BYTES = 8 << 20
PAIR_BYTES = 8 << 20
CHUNK = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ROLL = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# ------------------------------------------------------------------ features

def _word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, split a chunk at a time."""
    parts, at = [], 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and not text[end:end + 1].isspace():
            end += 1
        words = text[at:end].translate(_LOWER).split()
        if words:
            parts.append(hash_array(np.array(words, dtype=object), categorize=False))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def features(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    words = _word_hashes(text or b"")
    if not len(words):
        return words
    width = min(shingle, len(words))
    n = len(words) - width + 1
    words = mixed(words)
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(_ROLL) + words[i:i + n]
    return np.unique(mixed(h))


def masses(x: np.ndarray) -> np.ndarray:
    """A second hash of the features, which sets add up."""
    return mixed(x + np.uint64(_ROLL))


def key(mass: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    both = np.array([mass.sum(dtype=np.uint64), (mass * (mass >> np.uint64(1))).sum(dtype=np.uint64)]).view(np.int64)
    return int(both[0]), int(both[1])


def sketch(x: np.ndarray) -> list[int]:
    """Parities of the features by their low bits, in a power of two of at least LEAST_SKETCH cells and
    about twice as many as there are features. Half the cells are those of both halves, added up."""
    cells = max(LEAST_SKETCH, 1 << (3 * len(x) // 2 - 1).bit_length())
    odd = np.bincount((x & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


# ------------------------------------------------------------------ signatures

def most_differing(a: int, upto: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Most features in which a set of ``a`` and a similar one of at most ``upto`` differ; -1 if none is similar."""
    num, den = threshold
    most = -1
    for b in range(max(1, upto - num - den), upto + 1):
        shared = -(-num * (a + b) // (num + den))
        if shared <= min(a, b):
            most = max(most, a + b - 2 * shared)
    return most


@cache
def band_edges(threshold: tuple[int, int] = THRESHOLD) -> list[int]:
    """Least sizes of the bands; a set's partners lie in its own band or a neighbouring one."""
    num, den = threshold
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * den * den // (num * num) + 1)
    return out


@cache
def bands(a: int, threshold: tuple[int, int] = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(band, k, partitions, differing) of every band that a set of this size signs for: k is the most features in
    which it differs from a partner there, ``differing`` the most of any pair in the band."""
    num, den = threshold
    edges = band_edges(threshold)
    own = int(np.searchsorted(edges, a, side="right")) - 1
    out = []
    for band in (own, own + 1):
        low, top = edges[band], edges[band + 1] - 1
        upto = min(a * den // num, top)
        k = most_differing(a, upto, threshold) if upto >= low else -1
        if k < 1:  # only equal sets are similar
            continue
        most = most_differing(top, top, threshold)
        out.append((band, k, 2 * most + 1 if most <= SMALL else most + most // 3 + 4, most))
    return out


@cache
def _subsets(n: int, out: int) -> np.ndarray:
    """0/1 rows: every choice of n - out of n partitions."""
    rows = np.ones((len(list(combinations(range(n), out))), n), np.uint64)
    for row, gone in zip(rows, combinations(range(n), out), strict=True):
        row[list(gone)] = 0
    return rows


def signatures(x: np.ndarray, mass: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> list[tuple[int, int, np.ndarray]]:
    """(band, needed, signatures) for every band of a set of sorted features: it can do without hot ones
    if ``needed`` others are left."""
    out = []
    place = (x >> np.uint64(32)).astype(np.int64)
    for band, k, n, most in bands(len(x), threshold):
        part = (place * n) >> 32  # ranges of the hash, so in order
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        held, sums = part[starts], np.add.reduceat(mass, starts)
        if most <= SMALL:
            whole = np.zeros(n, np.uint64)
            whole[held] = sums
            which = _subsets(n, most)
            projected = (which * mixed(whole + np.uint64(1))).sum(axis=1, dtype=np.uint64)
            ids, needed = np.arange(len(which), dtype=np.uint64), len(which) + 1
        else:
            needed = k + 1
            if len(held) < needed:  # sign the empty ones too, and need all
                whole = np.zeros(n, np.uint64)
                whole[held] = sums
                held, projected, needed = np.arange(n), whole, n + 1
            else:
                spare = most // 8 + 4
                held, projected = held[:needed + spare], sums[:needed + spare]
            ids = held.astype(np.uint64)
        out.append((band, needed, mixed(mixed(projected) + mixed(ids + np.uint64(band << 32)))))
    return out


def wide_signatures(x: np.ndarray, mass: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Signatures of a crowded set: the partitions of a band in groups of WIDE[0], and of each group the projections
    on every subset that leaves out WIDE[1]. Of the groups one has no more differing partitions than that."""
    n, out = WIDE
    place, found = (x >> np.uint64(32)).astype(np.int64), []
    which = _subsets(n, out)
    for band, _, _, most in bands(len(x), threshold):
        groups = -(-(most + 1) // (out + 1))
        part = (place * (groups * n)) >> 32
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        whole = np.zeros(groups * n, np.uint64)
        whole[part[starts]] = np.add.reduceat(mass, starts)
        whole = mixed(whole + np.uint64(1)).reshape(groups, 1, n)
        projected = (whole * which).sum(axis=2, dtype=np.uint64).ravel()
        ids = np.arange(len(projected), dtype=np.uint64) + np.uint64((band << 32) + (1 << 62))
        found.append(mixed(mixed(projected) + mixed(ids)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


# ------------------------------------------------------------------ streams of texts

def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, features) of every text."""
    for b in batches:
        texts = b.column(column).cast(pa.binary())
        for i in range(b.num_rows):
            yield b, i, features(texts[i].as_py())


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, k1, k2, sketch) of every row; no key where there are no features."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("sketch", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, i, x in _texts(iter([b]), 2):
                k1, k2 = key(masses(x)) if len(x) else (None, None)
                rows.append({"doc_id": b.column(0)[i].as_py(), "text_hash": b.column(1)[i].as_py(), "n": len(x), "k1": k1, "k2": k2,
                             "sketch": sketch(x) if len(x) else None})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return (docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(work, "doc_id long, text_hash long, n long, k1 long, k2 long, sketch array<long>"))


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return starts, np.diff(starts, append=len(sorted_))


def _packed(sig: np.ndarray, own: np.ndarray, keys: np.ndarray, slices: int, hot: int) -> Iterator[dict]:
    """Signatures and their sets' keys by slice; of one that is hot already, only itself."""
    order = np.argsort(sig, kind="stable")
    sig, own = sig[order], own[order]
    starts, lengths = _runs(sig)
    crowded = sig[starts[lengths > hot]]
    few = np.repeat(lengths <= hot, lengths)
    sig, own = sig[few], own[few]
    part = lambda x: ((x >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
    mine, theirs = part(sig), part(crowded)
    for at in np.unique(np.concatenate([mine, theirs])).tolist():
        a, b = np.searchsorted(mine, [at, at + 1])
        who, numbers = np.unique(own[a:b], return_inverse=True)
        small = len(who) <= 1 << 16
        yield {"slice": at, "sigs": _planes(sig[a:b]) if b > a else b"", "keys": keys[who].tobytes(), "small": small,
               "owners": _planes(numbers.astype(np.uint16 if small else np.uint32)) if b > a else b"",
               "hot": crowded[theirs == at].tobytes()}


_PACKED = pa.schema([("slice", pa.int64()), ("sigs", pa.binary()), ("keys", pa.binary()), ("small", pa.bool_()), ("owners", pa.binary()),
                     ("hot", pa.binary())])


def packed_signatures(docs: DataFrame, slices: int, threshold: tuple[int, int], hot: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, keys, seen, size = [], [], [], set(), 0

        def rows() -> Iterator[pa.RecordBatch]:
            for row in _packed(np.concatenate(sigs), np.concatenate(owners), np.array(keys, np.int64), slices, hot):
                yield pa.RecordBatch.from_pylist([row], schema=_PACKED)

        for _, _, x in _texts(batches, 0):
            if not len(x) or (k := key(mass := masses(x))) in seen:
                continue
            seen.add(k)
            for _, _, s in signatures(x, mass, threshold):
                sigs.append(s)
                owners.append(np.full(len(s), len(keys), np.uint32))
                size += len(s)
            keys.append(k[0])
            if size >= BATCH_ENTRIES:
                yield from rows()
                sigs, owners, keys, seen, size = [], [], [], set(), 0
        if size:
            yield from rows()

    return docs.select("text").mapInArrow(work, "slice long, sigs binary, keys binary, small boolean, owners binary, hot binary")


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Sorted signatures with their sets' keys, and what else the rows of a slice have."""
    full = [r for r in rows if r["sigs"]]
    sig = np.concatenate([_values(r["sigs"], np.uint64) for r in full] or [np.zeros(0, np.uint64)])
    who = np.concatenate([np.frombuffer(r["keys"], np.int64)[_values(r["owners"], np.uint16 if r["small"] else np.uint32)] for r in full]
                         or [np.zeros(0, np.int64)])
    order = np.lexsort((who, sig))
    return sig[order], who[order], b"".join(r["hot"] for r in rows)


def shared_signatures(packed: DataFrame, hot: int) -> DataFrame:
    """(a, b, hot): pairs of sets with a signature in common that isn't hot, and the hot signatures."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.int64())])

    def work(group: pa.Table) -> pa.Table:
        sig, who, hots = _unpacked(group.to_pylist())
        crowded = np.unique(np.frombuffer(hots, np.uint64))
        if len(sig):  # copies of a set sign in every batch that they are in
            first = np.concatenate([[True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])])
            sig, who = sig[first], who[first]
        starts, lengths = _runs(sig)
        more = (lengths > hot) | np.isin(sig[starts], crowded)
        crowded = np.union1d(crowded, sig[starts[more]])
        a, b = [], []
        for n in np.unique(lengths[~more & (lengths > 1)]).tolist():
            at = starts[~more & (lengths == n)]
            i, j = np.triu_indices(n, 1)
            step = max(1, (1 << 20) // len(i))
            for k in range(0, len(at), step):
                x, y = (who[at[k:k + step, None] + m].ravel() for m in (i, j))
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                a.append(x[new])
                b.append(y[new])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        none, hots = pa.nulls(len(crowded), pa.int64()), crowded.view(np.int64)
        return pa.table([pa.concat_arrays([pa.array(a), none]), pa.concat_arrays([pa.array(b), none]),
                         pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(hots)])], schema=schema)

    return packed.groupBy("slice").applyInArrow(work, "a long, b long, hot long")


def signature_rows(docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(k1, band, over, sigs): ``over`` is how many hot signatures a set can do without. A batch's copies sign once."""
    schema = pa.schema([("k1", pa.int64()), ("band", pa.int32()), ("over", pa.int32()), ("sigs", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, rows = set(), []
            for _, _, x in _texts(iter([b]), 0):
                if not len(x) or (k := key(mass := masses(x))) in seen:
                    continue
                seen.add(k)
                rows += [{"k1": k[0], "band": band, "over": max(0, len(s) - needed), "sigs": s.view(np.int64)}
                         for band, needed, s in signatures(x, mass, threshold)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select("text").mapInArrow(work, "k1 long, band int, over int, sigs array<long>")


def feature_sets(docs: DataFrame) -> DataFrame:
    """(k1, k2, features) of every text."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("features", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for at in range(0, b.num_rows, 64):
                rows = []
                for _, _, x in _texts(iter([b.slice(at, 64)]), 0):
                    k1, k2 = key(masses(x))
                    if (k1, k2) in seen:
                        continue
                    seen.add((k1, k2))
                    rows.append({"k1": k1, "k2": k2, "features": x.view(np.int64)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select("text").mapInArrow(work, "k1 long, k2 long, features array<long>")


def family_edges(held: DataFrame, threshold: tuple[int, int], slices: int) -> DataFrame:
    """(a, b): edges that connect the sets (k1, features) that share a wide signature, directly or through others.

    Sets that a batch connects are one in what it sends, so that a signature costs a batch as many entries as
    it leaves families, whatever their size.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, keys, size = [], [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            sig, own, names = np.concatenate(sigs), np.concatenate(owners).astype(np.int64), np.array(keys, np.int64)
            order = np.lexsort((own, sig))
            sig, own = sig[order], own[order]
            root = roots_of(*_neighbours(sig, own), len(names))
            own = root[own]
            first = np.concatenate([[True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])])
            moved = np.flatnonzero(root != np.arange(len(names)))
            edges = np.stack([names[root[moved]], names[moved]], axis=1).tobytes()
            for row in _packed(sig[first], own[first], names, slices, len(names)):
                yield pa.RecordBatch.from_pylist([row | {"hot": edges}], schema=_PACKED)
                edges = b""

        for b in batches:
            sets = b.column(1)
            for i, k in enumerate(b.column(0).to_pylist()):
                x = sets[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                s = np.unique(wide_signatures(x, masses(x), threshold))
                sigs.append(s)
                owners.append(np.full(len(s), len(keys)))
                keys.append(k)
                size += len(s)
                if size >= BATCH_ENTRIES:
                    yield from rows()
                    sigs, owners, keys, size = [], [], [], 0
        if size:
            yield from rows()

    def meet(group: pa.Table) -> pa.Table:
        sig, who, edges = _unpacked(group.to_pylist())
        local = np.frombuffer(edges, np.int64).reshape(-1, 2)
        a, b = _neighbours(sig, who)
        both = np.unique(np.concatenate([local, np.stack([a, b], axis=1)]), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    packed = held.select("k1", "features").mapInArrow(work, "slice long, sigs binary, keys binary, small boolean, owners binary, hot binary")
    return packed.groupBy("slice").applyInArrow(meet, "a long, b long")


def _neighbours(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different neighbours with one signature, in sorted order."""
    same = (sig[1:] == sig[:-1]) & (who[1:] != who[:-1])
    return who[:-1][same], who[1:][same]


# ------------------------------------------------------------------ join

def _may_share(a: str, b: str, floor: tuple[int, int]) -> Column:
    """False only for sets (columns ``a``, ``b`` of structs n, sketch) of a similarity below the floor.
    The greater sketch is halved to the size of the other, once, as sets of one size class or the next meet; sets
    further apart aren't judged by it."""
    num, den = floor
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    x, y = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")

    def halved(c: Column) -> Column:
        half = (F.size(c) / 2).cast("int")
        return F.zip_with(F.slice(c, 1, half), F.slice(c, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    x, y = F.when(F.size(x) > F.size(y), halved(x)).otherwise(x), F.when(F.size(y) > F.size(x), halved(y)).otherwise(y)
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(F.bit_count(p.bitwiseXOR(q)), F.lit(0)).cast("long")),
                         F.lit(0).cast("long"), lambda s, n: s + n)
    apart = F.greatest(F.size(f"{a}.sketch"), F.size(f"{b}.sketch")) > 2 * F.least(F.size(f"{a}.sketch"), F.size(f"{b}.sketch"))
    return ((F.least(f"{a}.n", f"{b}.n") * den >= F.greatest(f"{a}.n", f"{b}.n") * num)
            & (apart | (differ * (num + den) <= both * (den - num))))


def likely(pairs: DataFrame, sets: DataFrame, floor: tuple[int, int]) -> DataFrame:
    """The pairs (a, b and other columns) that may reach the floor, by sizes and sketches."""
    told = sets.select("k1", F.struct("n", "sketch").alias("of"))
    x = pairs.join(told.select(F.col("k1").alias("a"), F.col("of").alias("of_a")), "a")
    x = x.join(told.select(F.col("k1").alias("b"), F.col("of").alias("of_b")), "b")
    return x.where(_may_share("of_a", "of_b", floor)).drop("of_a", "of_b")


def compared(pairs: DataFrame, held: DataFrame, pivots: bool = False) -> DataFrame:
    """The pairs (a, b; written) with the sets' nodes (node_a, node_b) and ``similarity``; ``held`` has the sets'
    features. Pairs are broadcast to the sets if measured to be few; with ``pivots`` many pairs have the same ``a``, and
    these sets are broadcast likewise."""
    node = F.concat(F.hex("k1"), F.lit("-"), F.hex("k2"))
    left = held.select(F.col("k1").alias("a"), node.alias("node_a"), F.col("features").alias("fa"))
    left = left.join(sized_broadcast(pairs.select("a").distinct()), "a", "left_semi")
    if pivots:
        left = sized_broadcast(left, PIVOT_BYTES)
    told = F.broadcast(pairs) if broadcast_fits(pairs, PAIR_BYTES) else pairs
    x = held.select(F.col("k1").alias("b"), node.alias("node_b"), F.col("features").alias("fb")).join(told, "b").join(left, "a")
    shared = F.size(F.array_intersect("fa", "fb")).cast("double")
    return (x.withColumn("shared", shared)
            .withColumn("similarity", F.col("shared") / (F.size("fa") + F.size("fb") - F.col("shared"))).drop("fa", "fb", "shared"))


def _linked(similarity: str, threshold: tuple[int, int]) -> Column:
    return F.col(similarity) >= F.lit(threshold[0] / threshold[1] - 1e-12)


def with_own(held: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(k1, n, own) of the sets that may have a partner among them: ``own`` counts the features that no other set
    has. A set of n features shares n - own of them at most, so more than n (1 - t) of its own leave it alone; without
    such sets others have more of their own, so it is looked at PEELS times."""
    num, den = threshold
    left = None
    for _ in range(PEELS):
        each = (held if left is None else held.join(sized_broadcast(left.select("k1")), "k1", "left_semi"))
        once = (each.select("k1", F.explode("features").alias("f")).groupBy("f").agg(F.min("k1").alias("k1"), F.count(F.lit(1)).alias("c"))
                .where("c = 1").groupBy("k1").agg(F.count(F.lit(1)).alias("own")))
        told = each.select("k1", F.size("features").alias("n")).join(once, "k1", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        left = materialize(told.where(F.col("own") * den <= F.col("n") * (den - num)))
    return left


def families(held: DataFrame, threshold: tuple[int, int], features: int) -> DataFrame:
    """(k1, family) of sets that share a wide signature, directly or through others; about so many features in all."""
    roots = components(family_edges(held, threshold, 1 + features // SLICE_ENTRIES))
    return (roots.select(F.col("node").alias("k1"), F.col("root").alias("family"))
            .unionByName(roots.select(F.col("root").alias("k1"), F.col("root").alias("family")).distinct()))


def _links_of(x: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    return x.where(_linked("similarity", threshold)).select("node_a", "node_b")


def _own_allow(x: str, y: str, threshold: tuple[int, int]) -> Column:
    """False only for dissimilar sets, by sizes and own features of the columns with these prefixes."""
    num, den = threshold
    half = lambda a, b: (F.col(f"{a}n") - F.col(f"{a}own")) * den >= (F.col(f"{a}n") + F.col(f"{b}own")) * num
    return half(x, y) & half(y, x)


def _classes(names: DataFrame, found: DataFrame) -> DataFrame:
    """(k1, class) of the sets of ``names`` (k1, node), by what the links connect; two sets with one k1 are a class alone."""
    roots = components(found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    each = names.join(sized_broadcast(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return each.groupBy("k1").agg(F.when(F.count(F.lit(1)) == 1, F.min("root")).otherwise(F.hex("k1")).alias("class"))


def _met(x: DataFrame, y: DataFrame, told: DataFrame, threshold: tuple[int, int], cond: Column) -> DataFrame:
    """(a, b): sets of ``x`` (k1, family, parts, class, n, own and others; x_ in ``cond``) and of ``y`` (y_) of one family that
    may be similar, by the condition, own features, sizes and sketches. A family's ``x`` are dealt to its parts; its ``y`` meet each."""
    told = told.select("k1", F.struct("n", "sketch").alias("of"))

    def side(df: DataFrame, prefix: str, part: Column) -> DataFrame:
        df = df.join(told, "k1").withColumn("part", part).drop("parts")
        return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in ("family", "part")})

    left = side(x, "x_", F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int"))
    right = side(y, "y_", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return (left.join(right.hint("merge"), ["family", "part"])
            .where(cond & (F.col("x_class") != F.col("y_class")) & _own_allow("x_", "y_", threshold) & _may_share("x_of", "y_of", threshold))
            .select(F.least("x_k1", "y_k1").alias("a"), F.greatest("x_k1", "y_k1").alias("b")))


def crowded_links(some: DataFrame, sets: DataFrame, held: DataFrame, threshold: tuple[int, int] = THRESHOLD,
                  listed: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Links that, with the ``known`` ones, connect all similar ones of some sets (of ``with_own``). At most ``listed``
    pairs of a family (LISTED for each set of the corpus) are listed; while there are more, every family's pivot takes
    what is near it. Sets that links connect already aren't paired."""
    num, den = threshold
    reach = 1 - num / den
    floor = (2 * num - den, den)
    listed = LISTED * sets.count() if listed is None else listed
    sets = materialize(sets.select("k1", "n", "sketch").join(sized_broadcast(some.select("k1")), "k1", "left_semi"))
    found = some.sparkSession.createDataFrame([], "node_a string, node_b string")
    names = materialize(held.join(sized_broadcast(some.select("k1")), "k1", "left_semi")
                        .select("k1", F.concat(F.hex("k1"), F.lit("-"), F.hex("k2")).alias("node")))
    if known is not None:  # what they connect of these sets, each with the least of its class
        roots = components(known.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
        known = materialize(roots.join(sized_broadcast(names.select("node")), "node", "left_semi").toDF("node_a", "node_b"))
    links_before = found if known is None else known

    def linked(x: DataFrame, y: DataFrame, cond: Column) -> DataFrame:
        return _links_of(compared(materialize(_met(x, y, sets, threshold, cond)), held), threshold)

    left, before = some, 0
    for turn in range(ROUNDS + 1):
        total = left.agg(F.sum("n")).first()[0] or 0
        group = families(held.join(sized_broadcast(left.select("k1")), "k1", "left_semi"), threshold, total)
        group = materialize(group.join(left, "k1").join(_classes(names, links_before.unionByName(found)), "k1"))
        sizes = group.groupBy("family", "class").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("family")
        sizes = sized_broadcast(sizes.agg(F.expr("(sum(c) * sum(c) - sum(c * c)) / 2").alias("pairs"),
                                          F.least(F.ceil(F.sum("c") / PART_SETS), F.lit(PARTS)).cast("int").alias("parts")).where("pairs > 0"))
        pairs = sizes.agg(F.sum("pairs")).first()[0]
        if not pairs:
            break
        group = group.join(sizes.drop("pairs"), "family")
        slow = turn > 0 and total > 0.9 * before
        before = total
        if pairs <= listed or slow or turn == ROUNDS:
            found = found.unionByName(linked(group, group, F.col("x_k1") < F.col("y_k1")))
            break
        drawn = Window.partitionBy("family").orderBy(F.xxhash64("k1", F.lit(turn)), "k1")
        candidates = group.select("family", F.col("k1").alias("a"), F.row_number().over(drawn).alias("nth")).where(F.col("nth") <= CANDIDATES)
        stars = group.join(sized_broadcast(candidates.select("family", "a")), "family").where("k1 <> a").select("family", "a", F.col("k1").alias("b"))
        near = materialize(compared(materialize(likely(stars, sets, floor)), held, pivots=True))
        taken = near.where(_linked("similarity", threshold)).groupBy("family", "a").agg(F.count(F.lit(1)).alias("links"))
        best = taken.groupBy("family").agg(F.max(F.struct("links", "a"))["a"].alias("a"))
        of = near.join(sized_broadcast(best), ["family", "a"]).select(F.col("b").alias("k1"), "similarity")
        told = group.join(sized_broadcast(best.select(F.col("a").alias("k1"))), "k1", "left_anti").join(of, "k1", "left")
        told = materialize(told.withColumn("core", F.coalesce(_linked("similarity", threshold), F.lit(False))))
        # a set beyond the pivot's links may still be similar to one of those
        shell = told.where(~F.col("core") & (F.col("similarity") >= 1 - 2 * reach - 1e-9))
        apart = F.col("y_similarity") - F.col("x_similarity") <= reach + 1e-9
        found = materialize(found.unionByName(_links_of(near, threshold)).unionByName(linked(shell, told.where("core"), apart)))
        left = told.where(~F.col("core")).select(*some.columns)
    return found


def links(docs: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD, hot: int = HOT) -> DataFrame:
    """Links (a, b) between nodes of distinct ``sets`` (k1, k2, n, sketch, text_hash) that connect
    exactly those that similar sets connect."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    slices = 1 + int(0.4 * total) // SLICE_ENTRIES
    found = materialize(shared_signatures(packed_signatures(docs, slices, threshold, hot), hot))
    pairs = materialize(likely(found.where("a is not null").select("a", "b").distinct(), sets, threshold))
    hots = found.where("hot is not null").select(F.col("hot").alias("sig"))
    crowded = None
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k1"))
    if not hots.isEmpty():
        rows = signature_rows(docs, threshold).select("k1", "band", "over", F.explode("sigs").alias("sig"))
        rows = materialize(rows.join(sized_broadcast(hots), "sig").distinct())
        hot_of = rows.groupBy("k1", "band").agg(F.count(F.lit(1)).alias("n"), F.max("over").alias("over"))
        crowded = materialize(hot_of.where("n > over").select("k1").distinct())
        wanted = wanted.unionByName(crowded)
    texts = sized_broadcast(sets.join(wanted.distinct(), "k1", "left_semi").select("text_hash").distinct())
    some = docs.withColumn("text_hash", F.xxhash64("text")).join(texts, "text_hash", "left_semi")
    held = materialize(feature_sets(some).dropDuplicates(["k1", "k2"]))
    out = materialize(_links_of(compared(pairs, held), threshold))
    if crowded is not None:
        some = with_own(held.join(sized_broadcast(crowded), "k1", "left_semi"), threshold)
        out = out.unionByName(crowded_links(some, sets, held, threshold, known=out))
    return out.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def jaccard_classes(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the number of its features and its class."""
    d = pick(docs, "doc_id", "text")
    rows = materialize(keyed(d))
    sets = materialize(rows.where("n > 0").groupBy("k1", "k2")
                       .agg(F.min("doc_id").alias("first_id"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"),
                            F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("copies")))
    roots = components(links(d, sets, threshold, hot))
    node = F.concat(F.hex("k1"), F.lit("-"), F.hex("k2"))
    named = sets.select("k1", "k2", "first_id", "copies", node.alias("node")).join(roots, "node", "left")
    named = materialize(named.withColumn("root", F.coalesce("root", "node")))
    linked = named.where(F.col("root") != F.col("node")).select("root").distinct()
    least = named.join(linked, "root", "left_semi").groupBy("root").agg(F.min("first_id").alias("least"))
    classes = (named.join(least, "root", "left").withColumn("component_id", F.coalesce("least", "first_id"))
               .where("least is not null or copies > 1").select("k1", "k2", "component_id"))
    out = rows.select("doc_id", "n", "k1", "k2").join(sized_broadcast(classes), ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
