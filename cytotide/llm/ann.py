"""Approximate nearest neighbours with balanced posting lists.

Centroids come from balanced bisection of a bounded sample: every cut splits
its vectors into halves, so the sample's lists are of one size. Where the table
has more than LIST_ROWS rows to such a list, a larger sample (about LIST vectors
to every LIST_ROWS rows) is dealt to the lists and each is bisected on, a task
each, so that the number of lists follows the number of rows. All centroids
are held in memory with a graph of their nearest neighbours, which is searched
best first. Every vector goes to the list of its nearest centroid and, at a
boundary, to further lists within CLOSURE times that distance, unless an
already chosen centroid is nearer to the further centroid than the vector is.
A query reads the lists whose centroids are within PRUNE times its nearest
centroid's distance, and scores their vectors exactly.

Lists are split into blocks of about BLOCK vectors, and the queries that read a
list into parts of about ASKED, so that a crowded list is many tasks. Of equal
vectors the index holds the k + 1 with the smallest ids: no query's k nearest
can have others. It covers every other row; only the centroids come from samples,
chosen by a hash of the vectors, equal ones counting once.

Defined results: vectors that are null, empty, zero, hold a null or a
non-finite component, or aren't of the most common length take no part; rows
without an id neither; of rows with equal id and vector one counts, and rows
that share an id are answered as one, a neighbour by its nearest vector; ties
go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytotide.llm.common import constant, materialize, pick

NEAREST = 5
SAMPLE = 20_000
#: Sampled vectors to a list, and the most lists: 2 ** DEEPEST.
LIST = 64
DEEPEST = 11
#: Rows to a list, beyond which lists are bisected on.
LIST_ROWS = 2048
LINKS = 16
#: Centroids that the graph search keeps, for placing vectors and for queries.
PLACE_BEAM = 24
QUERY_BEAM = 96
CLOSURE = 1.15
PRUNE = 1.6
REPLICAS = 4
BLOCK = 4096
ASKED = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """A vector that can take part."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def balanced_centroids(x: np.ndarray, depth: int) -> np.ndarray:
    """Unit centroids of 2 ** depth equal parts of unit vectors, by halving along two means."""
    parts = [np.arange(len(x))]
    for _ in range(depth):
        halves = []
        for p in parts:
            v = x[p]
            a = v[0]
            a, b = v[np.argmin(v @ a)], a
            a, b = v[np.argmin(v @ a)], a
            for _ in range(8):
                order = np.argsort(v @ (a - b), kind="stable")
                low, high = order[:len(p) // 2], order[len(p) // 2:]
                a, b = v[high].mean(axis=0), v[low].mean(axis=0)
            halves += [p[low], p[high]]
        parts = halves
    means = np.array([x[p].mean(axis=0) for p in parts])
    size = np.linalg.norm(means, axis=1, keepdims=True)
    return np.where(size > 1e-9, means / np.maximum(size, 1e-9), x[[p[0] for p in parts]])


def centroid_graph(centroids: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Each centroid's neighbours: its nearest ones, and a few at fixed random for long ways."""
    n, rng = len(centroids), np.random.default_rng(5)
    near = min(links, n - 1)
    out = np.empty((n, near + 4), dtype=np.int64)
    for i in range(0, n, 512):
        sims = centroids[i:i + 512] @ centroids.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -np.inf
        if n <= 4096:
            out[i:i + 512, :near] = np.argsort(-sims, axis=1, kind="stable")[:, :near]
        else:
            out[i:i + 512, :near] = np.argpartition(-sims, near, axis=1)[:, :near]
    out[:, near:] = rng.integers(0, n, (n, 4))
    return out


def graph_search(x: np.ndarray, centroids: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for many vectors at once: centroids found and distances, nearest first.

    Each round expands every vector's nearest unexpanded centroid in its beam, until all beams are expanded.
    """
    rows, n = len(x), len(centroids)
    beam = min(beam, n)
    entry = np.unique(np.linspace(0, n - 1, min(n, max(beam, 16))).astype(np.int64))
    seen = np.zeros((rows, n), dtype=bool)
    seen[:, entry] = True
    ids = np.broadcast_to(entry, (rows, len(entry)))
    sims = x @ centroids[entry].T
    order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    open_ = np.ones_like(ids, dtype=bool)
    live = np.arange(rows)
    while len(live):
        at = open_[live].argmax(axis=1)
        node = ids[live, at]
        open_[live, at] = False
        next_ = graph[node]
        fresh = ~seen[live[:, None], next_]
        seen[live[:, None], next_] = True
        got = np.where(fresh, np.einsum("rd,rkd->rk", x[live], centroids[next_]), -np.inf)
        # a neighbour listed twice counts once
        twice = np.sort(next_, axis=1)
        if (twice[:, 1:] == twice[:, :-1]).any():
            first = np.argsort(next_, axis=1, kind="stable")
            same = np.take_along_axis(next_, first, 1)
            again = np.zeros_like(fresh)
            np.put_along_axis(again, first, np.concatenate([np.zeros((len(live), 1), bool), same[:, 1:] == same[:, :-1]], axis=1), 1)
            got[again] = -np.inf
        all_ids = np.concatenate([ids[live], next_], axis=1)
        all_sims = np.concatenate([sims[live], got], axis=1)
        all_open = np.concatenate([open_[live], np.isfinite(got)], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[live], sims[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
        open_[live] = np.take_along_axis(all_open, order, 1)
        live = live[open_[live].any(axis=1)]
    return ids, np.sqrt(np.maximum(2 - 2 * sims, 0))


def boundary_lists(x: np.ndarray, centroids: np.ndarray, graph: np.ndarray) -> list[np.ndarray]:
    """The lists of each vector: its nearest centroid's, and replicas at boundaries."""
    ids, far = graph_search(x, centroids, graph, PLACE_BEAM)
    chosen = np.full((len(x), REPLICAS), -1)
    chosen[:, 0] = ids[:, 0]
    used = np.ones(len(x), dtype=np.int64)
    for j in range(1, ids.shape[1]):
        near = (far[:, j] <= CLOSURE * far[:, 0] + 1e-9) & (used < REPLICAS)
        for k in range(REPLICAS):
            held = near & (chosen[:, k] >= 0)
            gap = np.sqrt(np.maximum(2 - 2 * np.einsum("rd,rd->r", centroids[ids[:, j]], centroids[chosen[:, k]]), 0))
            near &= ~(held & (gap < far[:, j]))
        at = np.flatnonzero(near)
        chosen[at, used[at]] = ids[at, j]
        used[at] += 1
    return [c[:n] for c, n in zip(chosen, used, strict=True)]


def query_lists(x: np.ndarray, centroids: np.ndarray, graph: np.ndarray) -> list[np.ndarray]:
    """The lists that each query reads: centroids within PRUNE times the nearest one's distance."""
    ids, far = graph_search(x, centroids, graph, QUERY_BEAM)
    keep = far <= PRUNE * far[:, :1] + 1e-9
    return [i[k] for i, k in zip(ids, keep, strict=True)]


def _refined(sample: DataFrame, held) -> np.ndarray:
    """Centroids of lists of about LIST sampled vectors, by bisecting the vectors nearest to each of the held ones."""
    def nearest_one(x: np.ndarray, centroids: np.ndarray, graph: np.ndarray) -> list[np.ndarray]:
        return [i[:1] for i in graph_search(x, centroids, graph, PLACE_BEAM)[0]]

    def bisect(group: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(group.sort_values("vec_id")["embedding"]).astype(np.float64))
        parts = balanced_centroids(x, int(np.log2(max(len(x) / LIST, 1))))
        return pd.DataFrame({"list": group["list"].iloc[0], "part": np.arange(len(parts)), "centroid": list(parts)})

    found = (_placed(sample, nearest_one, held).groupBy("list").applyInPandas(bisect, "list int, part int, centroid array<double>")
             .toPandas().sort_values(["list", "part"]))
    fine = np.stack(found["centroid"])
    whole = np.setdiff1d(np.arange(len(held.value[0])), found["list"])  # lists that no sampled vector came to
    return _unit(np.concatenate([fine, held.value[0][whole]]))


def _counts_of(lists: DataFrame, n: int, most: int) -> Column:
    """For each row's list, the number of pieces of about ``most`` rows that it makes."""
    sizes = dict(lists.groupBy("list").agg(F.count(F.lit(1))).collect())
    pieces = [-(-sizes.get(i, 1) // most) for i in range(n)]
    return F.get(constant(lists.sparkSession, pieces, "array<int>"), F.col("list"))


def _placed(vectors: DataFrame, how, held) -> DataFrame:
    """Vectors with one row per list, ``how`` choosing the lists."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, graph = held.value
        for b in batches:
            if len(b):
                lists = how(_unit(np.stack(b["embedding"]).astype(np.float64)), centroids, graph)
                yield b.assign(list=[x.astype(np.int32) for x in lists])

    return (vectors.mapInPandas(place, "vec_id bigint, embedding array<float>, list array<int>")
            .withColumn("list", F.explode("list")))


def nearest(vectors: DataFrame, queries: Column, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each query row, by cosine.

    ``queries`` says by vec_id which rows are queries; every row is indexed.
    """
    spark = vectors.sparkSession
    d = pick(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<float>"))
    d = d.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = d.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    d = materialize(d.where(F.size("embedding") == lengths.n).distinct())
    n = d.count()

    def sampled(share: float) -> DataFrame:
        """Of the distinct vectors that share, each as a row whose vec_id is its hash."""
        u = F.pmod(F.xxhash64("embedding"), F.lit(2 ** 40))
        return d.select(F.xxhash64("embedding").alias("vec_id"), "embedding").where(u < share * 2 ** 40).dropDuplicates(["vec_id"])

    sample = sampled(SAMPLE / n).toPandas().sort_values("vec_id", ignore_index=True)
    depth = int(np.clip(np.log2(max(len(sample), 1) / LIST), 0, DEEPEST))
    x = np.stack(sample["embedding"] if len(sample) else d.limit(1).toPandas()["embedding"]).astype(np.float64)
    centroids = balanced_centroids(_unit(x), depth)
    held = spark.sparkContext.broadcast((centroids, centroid_graph(centroids)))
    if n > len(centroids) * LIST_ROWS and len(sample):
        centroids = _refined(sampled(LIST / LIST_ROWS), held) if sampled(LIST / LIST_ROWS).limit(1).count() else centroids
        held = spark.sparkContext.broadcast((centroids, centroid_graph(centroids)))

    same = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    index = d.withColumn("same", same).where(F.col("same") <= k + 1).drop("same")
    postings, asked = _placed(index, boundary_lists, held), _placed(d.where(queries), query_lists, held)
    blocks, parts = _counts_of(postings, len(centroids), BLOCK), _counts_of(asked, len(centroids), ASKED)
    postings = (postings.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
                .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))))
    asked = (asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), parts).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b = (np.stack(t["embedding"]).astype(np.float64) for t in (left, right))
        a_size, b_size = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        own, ids, out = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), []
        for i in range(0, len(a), 256):
            sims = (a[i:i + 256] / a_size[i:i + 256, None]) @ (b / b_size[:, None]).T
            sims[own[i:i + 256, None] == ids] = -np.inf
            for j, row in enumerate(sims, i):
                # those that may be among the k; their scores are then summed alike, so that equal vectors tie
                least = np.partition(row, -k)[-k] - 1e-12 if len(row) > k else -np.inf
                at = np.flatnonzero((row >= least) & np.isfinite(row))
                score = (b[at] * a[j]).sum(axis=1) / (b_size[at] * a_size[j])
                at, score = at[order := np.lexsort((ids[at], -score))[:k]], score[order]
                out.append((np.full(len(at), own[j]), ids[at], score))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = (asked.groupBy("list", "block", "part").cogroup(postings.groupBy("list", "block", "part"))
             .applyInPandas(search, "query_id bigint, vec_id bigint, score double"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
