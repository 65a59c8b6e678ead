"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are taken
in key order: whole epochs first, then the documents before the source's cut,
and of the document on the cut the words that are left of the budget. The cut
is found with distributed prefix sums: word totals per (source, key bucket)
are summed over buckets, and only the one bucket that holds a source's cut is
sorted row by row. The plan has one row per source; rows are judged against
it without moving.

Defined results: a null text has size 0 and takes 0 words; a null source is a
source of its own, last in order; rows equal in doc_id and size share a
position in the order and take the same number of words each (the group's
remainder divided, rounded down); an empty table gives an empty plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytotide.llm.common import materialize, pick, sized_broadcast, word_count, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Key buckets of a source: the row-by-row prefix sum covers 1/BUCKETS of its rows.
BUCKETS = 4096
SEED = "mix-1"
_NO_ID = -(2 ** 63)


def mix_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 hash-random bits of an id, the same on every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix_rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, key) of documents; the texts stay behind."""
    d = pick(docs, "doc_id", "text", "source")
    return d.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                    mix_key(F.col("doc_id"), seed).alias("key"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target words per source from (source, source_size), by water filling.

    Weights repeat over the sources in code-point order, null last. Targets
    share the total of all sizes by weight and stop at ``max_epochs`` times a
    source's size; the excess goes to the others by weight until none is
    above. With sources ordered by cap / weight, the water level is the first
    (total - caps before) / (weights from here on) that its own source can
    hold. One row per source, so the two orderings run on a table of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (sizes.withColumn("pos", F.row_number().over(by_name))
              .withColumn("weight", F.element_at(cycle, ((F.col("pos") - 1) % len(weights) + 1).cast("int")))
              .withColumn("cap", F.col("source_size") * max_epochs)
              .withColumn("ratio", F.col("cap").cast("double") / F.col("weight")))
    by_ratio = Window.orderBy("ratio", "pos")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward)
    return (ranked.withColumn("total", F.sum("source_size").over(everything))
            .withColumn("at", F.row_number().over(by_ratio)).withColumn("level", level)
            .withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(everything))
            .select("source", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("weight") * F.col("water.level")).alias("target")))


def mix_plan(rows: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: size, target, whole epochs and the place of the cut.

    ``rows`` are ``mix_rows`` (written once, as they are read twice).
    """
    bucket = F.shiftright("key", 60 - (BUCKETS.bit_length() - 1))
    sums = materialize(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    plan = materialize(targets.withColumn("epochs", epochs)
                       .withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    of_plan = plan.select(F.col("source").alias("plan_source"), "rest")
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)))
    at_cut = (starts.join(of_plan, same).where((F.col("rest") > 0) & (F.col("before") < F.col("rest"))
                                               & (F.col("before") + F.col("bucket_size") >= F.col("rest")))
              .select("plan_source", F.col("bucket").alias("cut_bucket"), (F.col("rest") - F.col("before")).alias("left")))
    inside = (rows.where(F.col("size") > 0).join(sized_broadcast(at_cut), same & (bucket == F.col("cut_bucket")))
              .groupBy("source", "key", "doc_id", "size")
              .agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left")))
    in_order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    inside = inside.withColumn("upto", F.sum(F.col("n") * F.col("size")).over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = (inside.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") * F.col("size") < F.col("left")))
           .select(F.col("source").alias("plan_source"), _position().alias("cut_at"),
                   F.floor((F.col("left") - F.col("upto") + F.col("n") * F.col("size")) / F.col("n")).cast("long")
                   .alias("cut_words")))
    return plan.join(cut, same, "left").drop("plan_source", "rest")


def _position() -> Column:
    return F.struct(F.col("key"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.col("size"))


def mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with ``source_size``, ``target``, ``epochs`` (whole copies) and
    ``cut_words`` (words of one more copy).

    The plan has a row per source; it is broadcast if its measured size
    allows, else joined by shuffle with AQE's skew split for hot sources.
    """
    small = sized_broadcast(plan).withColumnsRenamed({"source": "plan_source", "cut_words": "at_cut"})
    at = _position()
    cut = (F.when(F.col("cut_at").isNull(), 0).when(at < F.col("cut_at"), F.col("size"))
           .when(at == F.col("cut_at"), F.col("at_cut")).otherwise(0))
    return (rows.join(small, rows["source"].eqNullSafe(F.col("plan_source")))
            .withColumn("cut_words", cut.cast("long")).drop("plan_source", "cut_at", "at_cut"))


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS,
                  seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, cut_words, taken."""
    rows = materialize(mix_rows(docs, seed))
    out = mix(rows, mix_plan(rows, weights, max_epochs))
    return out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("cut_words")).drop("key")


def mixed_copies(docs: DataFrame, columns: tuple[str, ...], weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS,
                 seed: str = SEED) -> DataFrame:
    """The mix itself: the named columns of each document once per whole copy,
    and once more, cut to its first words, where the source's cut falls into it.

    Only the plan is joined to the texts. ``n_chars``, if named, follows the cut text.
    """
    plan = mix_plan(materialize(mix_rows(docs, seed)), weights, max_epochs)
    d = pick(docs, *dict.fromkeys((*columns, "doc_id", "text", "source")))
    ws = words(F.col("text"))
    d = mix(d.withColumns({"size": F.size(ws).cast("long"), "key": mix_key(F.col("doc_id"), seed)}), plan)
    last = F.when(F.col("cut_words") > 0, F.array("cut_words")).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("take", F.explode(F.concat(F.array_repeat("size", F.col("epochs").cast("int")), last)))
    d = d.withColumn("text", F.when(F.col("take") < F.col("size"), F.array_join(F.slice(ws, 1, F.col("take").cast("int")), " "))
                     .otherwise(F.col("text")))
    if "n_chars" in columns:
        d = d.withColumn("n_chars", F.when(F.col("take") < F.col("size"), F.length("text")).otherwise(F.col("n_chars")))
    return d.select(*columns)
