"""Quality classifier: random-indexing word vectors and a two-layer network.

Words are hashed to BUCKETS; a bucket's index vector has NONZERO entries of
+1 or -1 at places given by its hash. A bucket's context vector is the sum of
the index vectors of all neighbours within WINDOW words, over every document
of the corpus. A document is the mean of its words' unit context vectors,
rare words weighing more (SMOOTH / (SMOOTH + frequency)). A network with one
hidden layer scores it; a temperature fitted on rows kept from its training
calibrates the probability.

The corpus statistics cover all documents. The network is fitted on at most
TRAIN_ROWS labelled documents (those with the smallest hash of doc_id), the
one bounded sample here.

Defined results: null and empty texts are the zero vector and get the score
that the network gives that; several labels of a document are averaged and
count as 1 from 0.5 on; without labels of both kinds the score is the share
of label 1, or 0.5 without any label; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytotide.llm.common import materialize, pick

BUCKETS = 1 << 14
DIMENSION = 64
NONZERO = 4
WINDOW = 2
SMOOTH = 1e-3
TRAIN_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
#: One in so many of the training rows calibrates the temperature.
CALIBRATE = 5
#: Words of a text that are handled at a time.
CHUNK = 1 << 18
#: Partial sums are added up in so many blocks, each by FAN tasks first.
BLOCKS = 16
FAN = 16


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (BUCKETS + 1 x NONZERO); the last row, of no word, has sign 0."""
    rng = np.random.default_rng(7)
    place = rng.integers(0, DIMENSION, (BUCKETS + 1, NONZERO))
    sign = rng.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
    sign[BUCKETS] = 0
    return place, sign


def _buckets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word buckets of consecutive pieces of the texts and the row of each word; long texts come in several pieces."""
    held: list[bytes] = []
    rows: list[tuple[int, int]] = []

    def out() -> tuple[np.ndarray, np.ndarray]:
        hashed = hash_array(np.array(held, dtype=object), categorize=False) % np.uint64(BUCKETS)
        return hashed.astype(np.int64), np.repeat([i for i, _ in rows], [n for _, n in rows])

    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "replace").split()
        for at in range(0, len(words), CHUNK):
            part = words[at:at + CHUNK]
            held += part
            rows.append((i, len(part)))
            if len(held) >= CHUNK:
                yield out()
                held.clear()
                rows.clear()
    if held:
        yield out()


def _contexts(words: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
    """Add the neighbours' index vectors to each word's row of ``into`` (BUCKETS x DIMENSION, flat)."""
    place, sign = index_vectors()
    for off in range(1, WINDOW + 1):
        together = rows[off:] == rows[:-off]
        left, right = words[:-off][together], words[off:][together]
        for target, context in ((left, right), (right, left)):
            for j in range(NONZERO):
                into += np.bincount(target * DIMENSION + place[context, j], weights=sign[context, j], minlength=into.size)


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors (BUCKETS x DIMENSION) and counts of the buckets over all texts.

    A task's partial sums have a fixed size. They are added in two steps by
    tasks that stream over them, BLOCKS x FAN and then BLOCKS; the driver gets the sums.
    """
    step = BUCKETS // BLOCKS

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, counts = np.zeros(BUCKETS * DIMENSION), np.zeros(BUCKETS)
        for b in batches:
            for words, rows in _buckets(list(b["text"])):
                _contexts(words, rows, total)
                counts += np.bincount(words, minlength=BUCKETS)
        both = np.column_stack([total.reshape(BUCKETS, DIMENSION), counts]).astype(np.int64)
        if counts.any():
            small = np.abs(both).max() < 2 ** 31
            yield pd.DataFrame({"block": range(BLOCKS), "wide": not small,
                                "sums": [both[i * step:(i + 1) * step].astype(np.int32 if small else np.int64).tobytes() for i in range(BLOCKS)]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for block, wide, sums in zip(b["block"], b["wide"], b["sums"], strict=True):
                one = np.frombuffer(sums, dtype=np.int64 if wide else np.int32)
                totals[block] = totals[block] + one if block in totals else one.astype(np.int64)
        if totals:
            yield pd.DataFrame({"block": list(totals), "wide": True, "sums": [t.tobytes() for t in totals.values()]})

    schema = "block int, wide boolean, sums binary"
    sums = (pick(docs, "text").where("text is not null").mapInPandas(partial, schema)
            .withColumn("salt", F.spark_partition_id() % FAN).repartition(BLOCKS * FAN, "block", "salt")
            .select("block", "wide", "sums").mapInPandas(added, schema)
            .repartition(BLOCKS, "block").mapInPandas(added, schema).collect())
    table = np.zeros((BUCKETS, DIMENSION + 1))
    for r in sums:
        table[r.block * step:(r.block + 1) * step] = np.frombuffer(r.sums, dtype=np.int64).reshape(step, DIMENSION + 1)
    return table[:, :DIMENSION], table[:, DIMENSION]


def pooled_vectors(docs: DataFrame, vectors: np.ndarray, counts: np.ndarray, *columns: str) -> DataFrame:
    """The named columns of documents with ``pooled`` (float vector) of the text."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    weight = SMOOTH / (SMOOTH + counts / max(counts.sum(), 1.0))
    weighted = np.column_stack([unit * weight[:, None], weight]).astype(np.float32)
    held = docs.sparkSession.sparkContext.broadcast(weighted)

    @F.pandas_udf("array<float>")
    def pool(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), DIMENSION + 1))
        for words, rows in _buckets(list(texts)):
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            np.add.at(out, rows[starts], np.add.reduceat(held.value[words], starts, dtype=np.float64))
        mean = out[:, :DIMENSION] / np.maximum(out[:, DIMENSION:], 1e-12)
        return pd.Series(list(mean.astype(np.float32)))

    d = pick(docs, *dict.fromkeys((*columns, "text")))
    return d.select(*columns, pool(F.col("text")).alias("pooled"))


class Network(NamedTuple):
    """A fitted network; without hidden weights it gives ``share`` to every row."""

    share: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    params: tuple = ()
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.params
        return np.tanh((x - self.mean) / self.spread @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not self.params:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Network:
    """A two-layer network fitted with Adam, its temperature on the rows ``apart``."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or y.min() == y.max():
        return Network(share)
    if not (0 < y[~apart].mean() < 1):
        apart = np.zeros(len(y), dtype=bool)
    mean, spread = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-6
    rng = np.random.default_rng(11)
    params = [rng.normal(0, DIMENSION ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    a, b, step = (x[~apart] - mean) / spread, y[~apart], 0

    for _ in range(EPOCHS):
        order = rng.permutation(len(b))
        for i in range(0, len(b), 256):
            v, t = a[order[i:i + 256]], b[order[i:i + 256]]
            h = np.tanh(v @ params[0] + params[1])
            err = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - t) / len(t)
            back = np.outer(err, params[2]) * (1 - h * h)
            grads = [v.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ err + 1e-4 * params[2], err.sum(keepdims=True)]
            step += 1
            for p, g, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= 0.005 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)

    model = Network(share, mean, spread, tuple(params))
    scales = np.exp(np.linspace(np.log(0.2), np.log(10), 200))
    z, t = (model.logits(x[apart]), y[apart]) if apart.any() else (model.logits(x), y)
    loss = [np.logaddexp(0, np.where(t > 0.5, -z, z) / s).mean() for s in scales]
    return model._replace(temperature=float(scales[int(np.argmin(loss))]))


def score(docs: DataFrame, labels: DataFrame, learnable: Column, *columns: str) -> DataFrame:
    """The named columns of documents (doc_id among them) with ``score``.

    ``learnable`` says by doc_id which documents' labels may teach.
    """
    vectors, counts = word_vectors(docs)
    pooled = materialize(pooled_vectors(docs, vectors, counts, *columns))
    known = (pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").where(learnable)
             .groupBy("doc_id").agg(F.avg("quality").alias("quality")))
    order = F.xxhash64("doc_id", F.lit(3))
    known = known.orderBy(order, "doc_id").limit(TRAIN_ROWS)
    rows = pooled.select("doc_id", "pooled").join(known, "doc_id").groupBy("doc_id").agg(
        F.first("pooled").alias("pooled"), F.first("quality").alias("quality")).toPandas().sort_values("doc_id", ignore_index=True)
    x = np.stack(rows["pooled"]).astype(np.float64) if len(rows) else np.zeros((0, DIMENSION))
    y = (rows["quality"].to_numpy(dtype=np.float64) >= 0.5).astype(np.float64)
    ids = rows["doc_id"].to_numpy().astype(np.int64).astype(np.uint64)
    apart = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(CALIBRATE) == 0
    model = docs.sparkSession.sparkContext.broadcast(tuple(fit(x, y, apart)))

    @F.pandas_udf("double")
    def probability(v: pd.Series) -> pd.Series:
        return pd.Series(Network(*model.value).probabilities(np.stack(v).astype(np.float64)) if len(v) else [], dtype="float64")

    return pooled.select(*columns, probability("pooled").alias("score"))
