"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's 64-bit fingerprint is the bitwise majority of its word shingles'
XXH64 hashes. Distinct fingerprints at a Hamming distance of at most ``tau``
are linked; linked fingerprints and equal ones form a class.

The search groups correlated bits into m partitions and gives every partition
its own threshold t_i with sum(t_i) = tau - m + 1 (t_i = -1: not probed). Two
fingerprints within ``tau`` then differ by at most t_i in some partition i, so
probing each partition's values within t_i finds every link. m and the
thresholds come from a dynamic program over estimated costs: the probes plus
the candidates, which are measured exactly for t = 0 (pairs of fingerprints
that agree on a partition, or the balls of those on a crowded value) and scaled
by the bits' difference rates beyond.
Candidates are verified on all 64 bits.

A partition value shared by more than HOT fingerprints isn't paired. Its
members, and whoever probes it, are linked exactly through their balls of
radius 1 instead: fingerprints within distance 2 share a ball element, and all
that share one are within distance 2 of each other, so each is linked to the
least of them. A ball element has at most 65 owners, whatever the data. (For
other values of ``tau`` the radius is tau / 2 rounded up, and links are verified.)

Defined results: null and empty texts have fingerprint 0 and are linked like
any other; fewer words than a shingle make one shingle of all of them; a class
is named by its smallest doc_id, null where it has none; repeated rows fall
into the class of their text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytotide.llm.common import materialize, pick, sized_broadcast
from cytotide.llm.components import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
BITS = 64
#: Fingerprints on one partition value, above which they aren't paired.
HOT = 64
#: Words hashed at a time: bounds the memory of a very long text.
CHUNK = 1 << 16
#: A verified candidate costs about as much as so many probes.
VERIFY_COST = 4.0
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _set_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _SPREAD).ravel()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    last = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, last, CHUNK):
        part = words[at:min(at + CHUNK, last) + shingle - 1]
        runs = zip(*[part[i:] for i in range(min(shingle, len(part)))], strict=False)
        ones += _set_counts([hashed(b" ".join(run), SEED) for run in runs])
    return int((ones * 2 > last) @ (1 << np.arange(BITS, dtype=object)))


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a signed long with the same bits."""
    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="uint64").astype("int64")
    return udf(text)


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((BITS, BITS), dtype=np.int64)
        n = 0
        for b in batches:
            x = np.unpackbits(b["fp"].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (x.T @ x).astype(np.int64)
            n += len(x)
        yield pd.DataFrame({"bit": range(-1, BITS), "counts": [[n] * BITS, *both.tolist()]})

    summed = (distinct.select("fp").mapInPandas(partial, "bit int, counts array<bigint>")
              .select("bit", F.posexplode("counts").alias("other", "n"))
              .groupBy("bit", "other").agg(F.sum("n").alias("n")).collect())
    out = np.zeros((BITS + 1, BITS), dtype=np.int64)
    for r in summed:
        out[r.bit + 1, r.other] = r.n
    return int(out[0, 0]), out[1:]


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of near-equal size, each grown from the bit that is left with
    the strongest correlations by adding the bit most correlated with the group."""
    p = np.diag(both) / max(n, 1)
    var = p * (1 - p)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.outer(var, var))
    corr = np.abs(np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 1e-12))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for i in range(m):
        size = BITS * (i + 1) // m - BITS * i // m
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left -= {group[0]}
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: corr[b, group].sum()))
            left -= {group[-1]}
        groups.append(sorted(group))
    return groups


def _difference_odds(rates: np.ndarray, most: int) -> np.ndarray:
    """P(number of differing bits = 0..most) for bits that differ independently at these rates."""
    odds = np.zeros(most + 1)
    odds[0] = 1.0
    for q in rates:
        odds[1:] = odds[1:] * (1 - q) + odds[:-1] * q
        odds[0] *= 1 - q
    return odds


def allocate(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i with sum ``budget`` and least total cost: dynamic program over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, chosen) in best.items():
            for t, c in cost.items():
                option = (total + c, [*chosen, t])
                step[spent + t] = min(step.get(spent + t, option), option)
        best = step
    return best[budget]


def plan_search(distinct: DataFrame, tau: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The partitions to probe, each with its threshold."""
    n, both = bit_statistics(distinct)
    p = np.diag(both) / max(n, 1)
    rates = 2 * p * (1 - p)
    groups = {m: correlated_groups(n, both, m) for m in range(1, tau + 2)}
    values = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask(g))).alias("value"))
              for m, gs in groups.items() for i, g in enumerate(gs)]
    sizes = distinct.select(F.explode(F.array(*values)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    c = F.col("c").cast("double")
    pairs = F.when(c > HOT, (BITS + 1) * c).otherwise(c * (c - 1) / 2)  # crowded values aren't paired, but cost their balls
    agree = {(r.m, r.i): r.pairs for r in sizes.groupBy("x.m", "x.i").agg(F.sum(pairs).alias("pairs")).collect()}
    options = []
    for m, gs in groups.items():
        costs = []
        for i, g in enumerate(gs):
            odds = _difference_odds(rates[g], tau).cumsum()
            cost = {-1: 0.0}
            for t in range(tau + 1):
                found = agree.get((m, i), 0.0) * odds[t] / max(odds[0], 1e-300)
                cost[t] = n * sum(comb(len(g), k) for k in range(t + 1)) + VERIFY_COST * found
            costs.append(cost)
        total, chosen = allocate(costs, tau - m + 1)
        options.append((total, m, [(g, t) for g, t in zip(gs, chosen, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[:2])[2]


def mask(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    return int(np.array([sum(1 << b for b in bits)], dtype=np.uint64).view(np.int64)[0])


def flips(bits: list[int], most: int) -> list[int]:
    """All masks of at most ``most`` of the bits, none first."""
    out = [[]]
    for _ in range(most):
        out += [[*f, b] for f in out for b in bits if not f or b > f[-1]]
    return [mask(f) for f in sorted({tuple(f) for f in out}, key=lambda f: (len(f), f))]


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _ball(fps: DataFrame, radius: int) -> DataFrame:
    """(at, fp) for every fingerprint ``at`` within the radius of ``fp``."""
    near = F.array(*[F.lit(x).cast("long") for x in flips(list(range(BITS)), radius)])
    return fps.select("fp", F.explode(F.transform(near, lambda x: x.bitwiseXOR(F.col("fp")))).alias("at"))


def links(distinct: DataFrame, tau: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those within ``tau``.

    ``distinct`` has one row per fingerprint in column ``fp`` and has been written.
    """
    plan = plan_search(distinct, tau)

    def keys(part: int, group: list[int], t: int) -> Column:
        near = F.array(*[F.lit(x).cast("long") for x in flips(group, t)])
        value = F.col("fp").bitwiseAND(F.lit(mask(group)))
        return F.transform(near, lambda x: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(x).alias("value")))

    def probes(radius: bool) -> DataFrame:
        each = [keys(i, group, t if radius else 0) for i, (group, t) in enumerate(plan)]
        return distinct.select("fp", F.explode(F.concat(*each)).alias("k")).select("fp", "k.part", "k.value")

    index = probes(radius=False)
    crowded = sized_broadcast(index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("c"))
                              .where(F.col("c") > hot).select("part", "value"))
    at = ["part", "value"]
    pairs = (probes(radius=True).withColumnRenamed("fp", "a")
             .join(index.join(crowded, at, "left_anti").withColumnRenamed("fp", "b"), at)
             .where((F.col("a") < F.col("b")) & (_differ("a", "b") <= tau)).select("a", "b"))
    members = probes(radius=True).join(crowded, at, "left_semi").select("fp").distinct()
    owners = _ball(members, (tau + 1) // 2).groupBy("at").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
    stars = owners.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    if tau % 2:
        # an odd radius also joins fingerprints at tau + 1: pair the owners of a ball element, and verify
        stars = (owners.select(F.col("all").alias("left"), F.explode("all").alias("b"))
                 .select(F.explode("left").alias("a"), "b").where((F.col("a") < F.col("b")) & (_differ("a", "b") <= tau)))
    return pairs.unionByName(stars).distinct()


def simhash_classes(docs: DataFrame, shingle: int = SHINGLE, tau: int = DISTANCE,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, root, component_id) and the carried columns per document;
    ``root`` names the class also where no member has a doc_id."""
    d = pick(docs, "doc_id", "text", *carry)
    rows = materialize(d.select("doc_id", *carry, fingerprints(F.col("text"), shingle).alias("fp")))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct, tau))
    named = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                        .withColumn("root", F.coalesce("root", "fp")))
    linked = named.where(F.col("root") != F.col("fp")).select("root").distinct()
    first = named.join(linked, "root", "left_semi").groupBy("root").agg(F.min("first_id").alias("least"))
    classes = (named.join(first, "root", "left")
               .select("fp", "root", F.coalesce("least", "first_id").alias("component_id")))
    return rows.join(classes, "fp")


def one_of_each(docs: DataFrame, columns: tuple[str, ...], shingle: int = SHINGLE, tau: int = DISTANCE) -> DataFrame:
    """The named columns of one document of each class: the one with the
    smallest doc_id, null last, then the smallest hash of the whole row; one of repeated rows.

    Only ids and hashes are shuffled to decide. The texts are filtered in
    place by the kept rows' keys where these fit a broadcast.
    """
    d = pick(docs, *columns).withColumn("row_hash", F.xxhash64(*columns))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row_hash").alias("key")
    classes = simhash_classes(d, shingle, tau, carry=("row_hash",))
    counted = classes.groupBy("root", key).agg(F.count(F.lit(1)).alias("n"))
    kept = materialize(counted.groupBy("root").agg(F.min(F.struct("key", "n")).alias("k")).select("k.key", "k.n"))
    d = d.withColumn("key", key)
    out = d.join(sized_broadcast(kept.where("n = 1").select("key")), "key", "left_semi")
    again = kept.where("n > 1").select("key")
    if not again.isEmpty():
        first = Window.partitionBy("key").orderBy("row_hash")
        once = d.join(again, "key", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
        out = out.unionByName(once)
    return out.select(*columns)
