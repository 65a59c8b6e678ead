"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id). A size-weighted sample of
keys gives quantile boundaries, the records are range-partitioned by them, and
ranges that turn out overfull are sampled again and subdivided. Exact byte and
row totals per range then place every record on one global line of bytes,
which is cut into equal shards.

Equal texts lie next to each other. A group of equal texts goes to one shard
by its middle, unless it alone holds more than ``whole_share`` of a shard;
then its members are placed one by one, as are all other records.

Defined results: a null text counts as no bytes (size 1, null checksum); a
null doc_id sorts first among equal texts; records equal in text and doc_id
are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytotide.llm.common import constant, materialize, pick

SHARDS = 16
#: Fewest and most ranges that the records are dealt to, bytes of a range between these, and sampled keys for each.
RANGES = 512
MOST_RANGES = 8192
RANGE_BYTES = 256 << 20
OVERSAMPLE = 32
#: A range is overfull above so many times its even share.
OVERFULL = 2.0
#: Groups of equal texts up to this part of a shard stay together.
WHOLE_SHARE = 0.01
_NO_ID = -(2 ** 63)


def shard_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """Documents with their order key (``k1``, ``k2``) and ``size``; ``keep`` names columns to carry."""
    d = pick(docs, *dict.fromkeys(("doc_id", "text", *keep)))
    d = (d.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.coalesce(F.col("doc_id"), F.lit(_NO_ID)))
         .withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
         .withColumn("text_crc32", F.crc32(F.encode("text", "UTF-8"))))
    return d if "text" in keep else d.drop("text")


def _draws(rows: DataFrame, sampled: float, total: int, n: int, seed: int) -> DataFrame:
    """Sampled keys with how often each was drawn: on average ``sampled`` draws,
    half of them by bytes and half by rows. The draw is a hash of the key, so reruns agree."""
    u = F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), F.lit(2 ** 52)) / float(2 ** 52)
    expect = (F.col("size") / float(total) + 1.0 / n) * (sampled / 2)
    return rows.select("k1", "k2", F.floor(expect + u).cast("int").alias("draws")).where("draws > 0")


def _quantiles(sample: list, parts: int) -> list[tuple[int, int]]:
    """Keys at the quantiles of a weighted sample: the first keys of ranges 2, 3, ..."""
    sample = sorted(sample)
    upto, total = [], 0
    for _, _, w in sample:
        upto.append(total := total + w)
    at = [bisect_left(upto, total * i / parts) for i in range(1, parts)] if total else []
    return sorted({tuple(sample[i][:2]) for i in at})


def with_range(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Rows with ``range``, the number of bounds at or below their key, by binary search.

    The bounds are constant arrays (at most a few times RANGES entries).
    """
    if not bounds:
        return rows.withColumn("range", F.lit(0))
    first, second = (F.array(*[F.lit(b[i]).cast("long") for b in bounds]) for i in (0, 1))
    widths = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def step(at, width):
        k1 = F.get(first, at + width - 1)  # null past the end, and then the step isn't taken
        taken = (k1 < F.col("k1")) | ((k1 == F.col("k1")) & (F.get(second, at + width - 1) <= F.col("k2")))
        return at + F.when(taken, width).otherwise(0)

    return rows.withColumn("range", F.aggregate(widths, F.lit(0), step))


def _totals(rows: DataFrame, bounds: list) -> list:
    """(range, bytes, rows, first key, last key), at most one per range."""
    key = F.struct("k1", "k2")
    return sorted(with_range(rows, bounds).groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect())


def _whole_groups(rows: DataFrame, bounds: list, whole: int) -> list[tuple[int, int]]:
    """The bounds, moved to the start of the group of equal texts (``k1``) that they lie in unless it is larger than ``whole``."""
    if not bounds:
        return bounds
    at = rows.sparkSession.createDataFrame([(k,) for k in sorted({b[0] for b in bounds})], "k1 long")
    size = {r.k1: r.bytes for r in rows.join(F.broadcast(at), "k1").groupBy("k1").agg(F.sum("size").alias("bytes")).collect()}
    return sorted({(k1, k2) if size.get(k1, 0) > whole else (k1, _NO_ID) for k1, k2 in bounds})


def splitters(rows: DataFrame, ranges: int | None = None, oversample: int = OVERSAMPLE, shards: int = SHARDS,
              whole_share: float = WHOLE_SHARE) -> tuple[list, list]:
    """Range boundaries and exact totals per range. Without ``ranges`` there is one for each RANGE_BYTES, from RANGES
    to MOST_RANGES. No boundary splits a group of equal texts of up to ``whole_share`` of a shard.

    ``rows`` (k1, k2, size) are read once for the totals, once for the sample, once for the groups that
    boundaries lie in and once more for each round of subdividing. What reaches the driver is
    the sample and one row per range, both set by the parameters.
    """
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return [], []
    ranges = ranges or min(MOST_RANGES, max(RANGES, total // RANGE_BYTES))
    whole = int(total / shards * whole_share)
    bounds = _quantiles(_draws(rows, ranges * oversample, total, n, 1).collect(), ranges)
    seed = 1
    while True:
        found, seed = _totals(rows, bounds), seed + 1
        share = {r.range: (r.bytes / total + r.n / n) / 2 * ranges for r in found}
        over = [r for r in found if share[r.range] > OVERFULL and r.lo != r.hi]
        more: set = set()
        if over:
            of = with_range(rows, bounds).where(F.col("range").isin([r.range for r in over]))
            drawn: dict = {}
            for r in _draws(of, ranges * oversample, total, n, seed).select("k1", "k2", "draws").collect():
                drawn.setdefault(sum(b <= (r.k1, r.k2) for b in bounds), []).append(tuple(r))
            for r in over:
                lo = tuple(r.lo)
                more |= {b for b in _quantiles(drawn.get(r.range, []), int(share[r.range]) + 1) if b > lo}
        if not more - set(bounds):
            kept = _whole_groups(rows, bounds, whole)
            return kept, found if kept == bounds else _totals(rows, kept)
        bounds = sorted({*bounds, *more})


def range_shard(rows: DataFrame, shards: int = SHARDS, ranges: int | None = None, oversample: int = OVERSAMPLE,
                whole_share: float = WHOLE_SHARE) -> DataFrame:
    """``rows`` of ``shard_rows`` with ``shard`` (0 to shards-1) and ``slot``
    (gapless from 0 within the shard). The records move to their range; no range is gathered anywhere else."""
    keys = materialize(rows.select("k1", "k2", "size"))
    bounds, found = splitters(keys, ranges, oversample, shards, whole_share)
    total = sum(r.bytes for r in found)
    starts, bytes_before, rows_before = {}, 0, 0
    for r in found:
        starts[r.range] = (bytes_before, rows_before)
        bytes_before, rows_before = bytes_before + r.bytes, rows_before + r.n
    starts = [starts.get(i, (0, 0)) for i in range(len(bounds) + 1)]
    spark = rows.sparkSession
    byte_at = constant(spark, [b for b, _ in starts], "array<bigint>")
    row_at = constant(spark, [n for _, n in starts], "array<bigint>")
    order = Window.partitionBy("range").orderBy("k1", "k2")
    group = Window.partitionBy("range", "k1")
    whole = int(total / shards * whole_share)

    def placed(x: DataFrame) -> DataFrame:
        x = with_range(x, bounds).repartition("range")
        x = (x.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .withColumn("line", F.get(row_at, F.col("range")) + F.row_number().over(order) - 1)
             .withColumn("group_size", F.sum("size").over(group)).withColumn("group_upto", F.max("upto").over(group)))
        # twice the middle of the record, or of its group, on the line of bytes
        middle = F.get(byte_at, F.col("range")) * 2 + F.when(
            F.col("group_size") <= whole, F.col("group_upto") * 2 - F.col("group_size")).otherwise(F.col("upto") * 2 - F.col("size"))
        shard = F.floor(middle.cast("double") / (2.0 * max(total, 1)) * shards).cast("int")
        return x.withColumn("shard", F.least(shard, F.lit(shards - 1))).drop("range", "upto", "group_size", "group_upto")

    first = dict(placed(keys).groupBy("shard").agg(F.min("line")).collect())
    first_at = constant(spark, [first.get(i, 0) for i in range(shards)], "array<bigint>")
    return placed(rows).withColumn("slot", F.col("line") - F.get(first_at, F.col("shard"))).drop("line", "k1", "k2")
