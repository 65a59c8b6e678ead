"""Gridded particle counts: bin decoding (J11) and diameters.

A gridded row stores an integer bin coordinate per channel; the bin's start
value lives in the grid-bins table at that **1-based row position**. The
bins table is grid-sized (a few hundred rows per cruise): it becomes one row
of arrays per cruise, met once by each gridded row. An out-of-range
coordinate decodes to NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.functions.columns import drop_suffix
from cytotide.functions.numeric import equivalent_diameter
from cytotide.operators.joins import keyed_join

# Fixed values from the reference: decoded channels of the gridded data.
GRID_CHANNELS = ("fsc_small", "chl_small", "pe", "Qc")


def decode_bins(gridded: DataFrame, bins: DataFrame, channels=GRID_CHANNELS, idx: str = "idx",
                by=(), diameter: str | None = "diam") -> DataFrame:
    """J11 (+ F5): replace ``{ch}_coord`` with the bin start ``{ch}`` for every
    channel, drop the coordinates, and add ``diam`` from ``Qc``.

    ``bins`` holds ``by`` keys, the 1-based position ``idx`` and one column
    per channel (see ``cytotide.sources.parquet.grid_bins``).
    """
    by = list(by)
    held = bins.where(F.col(idx).isNotNull()).select(*by, F.col(idx).cast("int").alias("__i"), *channels)
    # every position up to the last, so that entry p of the arrays is bin p; positions that the table lacks are NULL
    last = held.groupBy(*by).agg(F.max("__i").alias("__last"))
    every = last.where("__last >= 1").select(*by, "__last", F.explode(F.sequence(F.lit(1), "__last")).alias("__i"))
    lists = every.join(held, [*by, "__i"], "left").groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("__i", *channels))).alias("__rows"), F.max("__last").alias("__last"))
    twice = F.raise_error(F.concat(F.lit("two grid bins for one position"), *[F.concat(F.lit(f", {k} "), F.col(k).cast("string")) for k in by]))
    rows = F.when(F.size("__rows") > F.col("__last"), twice.cast(lists.schema["__rows"].dataType)).otherwise(F.col("__rows"))
    arrays = lists.withColumn("__rows", rows).select(*by, *[F.col("__rows").getField(c).alias(f"__{c}") for c in channels])
    out = keyed_join(gridded, arrays, by)
    out = out.withColumns({c: F.get(F.col(f"__{c}"), F.col(f"{c}_coord").cast("int") - 1) for c in channels})
    out = drop_suffix(out, "_coord").drop(*[f"__{c}" for c in channels])
    if diameter and "Qc" in channels:
        out = out.withColumn(diameter, equivalent_diameter("Qc"))
    return out
