"""Gating polygons.

Gating definitions (one row per id and population, with the two channels the
gate is drawn on) and polygon vertices (one row per vertex) are small,
parameter-sized tables, joined without hints: Spark's statistics and AQE
choose the join strategy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.functions.numeric import nan_to_null


def gate_outlines(gating: DataFrame, poly: DataFrame, pairs, by=()) -> DataFrame:
    """Polygon vertices of every gate drawn on one of the channel ``pairs`` (x, y).

    A gate matches a pair when its two channels equal it as a set (either
    order); a missing channel skips the gate. Vertices are matched on
    ``(keys, gating_id, pop)``, in one join for all pairs. Output: keys,
    ``gating_id, pop, x, y, pair`` plus ``point_order`` / ``pop_order`` when
    the inputs carry them.
    """
    by, pairs = list(by), list(pairs)
    c1, c2 = F.col("channel1"), F.col("channel2")
    drawn = F.array_compact(F.array(*[
        F.when(((c1 == x) & (c2 == y)) | ((c1 == y) & (c2 == x)), F.lit(i)) for i, (x, y) in enumerate(pairs)]))
    orders = [c for c in ("pop_order",) if c in gating.columns]
    gates = gating.where(c1.isNotNull() & c2.isNotNull()) \
        .select(*by, F.col("id").alias("gating_id"), "pop", *orders, F.explode(drawn).alias("__pair"))
    keep = [c for c in ("point_order",) if c in poly.columns]
    channels = sorted({c for pair in pairs for c in pair})
    # Both sides are parameter-sized: Spark picks the join from its statistics.
    out = poly.select(*by, "gating_id", "pop", *channels, *keep).join(gates, on=[*by, "gating_id", "pop"], how="inner")

    def of_pair(values):
        return F.element_at(F.array(*values), F.col("__pair") + 1)

    return out.select(*by, "gating_id", "pop", of_pair([F.col(x) for x, _ in pairs]).alias("x"),
                      of_pair([F.col(y) for _, y in pairs]).alias("y"), *keep, *orders,
                      of_pair([F.lit(f"{y} vs {x}") for x, y in pairs]).alias("pair"))


def gate_centroids(outlines: DataFrame, keys=("gating_id", "pop"), by=()) -> DataFrame:
    """A4: label position of each gate: mean x and y of its vertices (missing
    and NaN removed), with ``pop_order`` when present."""
    keys = [*by, *keys] + (["pop_order"] if "pop_order" in outlines.columns else [])
    return outlines.groupBy(*keys).agg(F.avg(nan_to_null("x")).alias("x"), F.avg(nan_to_null("y")).alias("y"))


def polygons_for_pop(poly: DataFrame, pop: str) -> DataFrame:
    """Vertex rows of one population, across gating ids (as the reference does) and the keys they carry."""
    return poly.where(F.col("pop") == F.lit(pop))
