"""Aggregations and set operations.

Every grouped aggregate here is algebraic (sum / count / min / max / avg,
partially aggregated map-side) except the medians of ``hourly_stat``. Their
grain is (keys, hour, population), and a Stat table has one row per 3-minute
point and population: about 20 rows a group, whatever the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.functions.numeric import nan_to_null
from cytotide.functions.time import floor_hour
from cytotide.operators.filters import flag_text

# Fixed values from the reference: Stat metrics medianed per hour, and the count summed.
HOURLY_MEDIAN_METRICS = ("opp_evt_ratio", "abundance", "fsc_med", "chl_med", "pe_med", "diameter")
HOURLY_SUM_METRIC = "n_count"
# Population label excluded from the default selection.
UNKNOWN_POP = "unknown"


def hourly_stat(df: DataFrame, time: str = "time", pop: str = "pop", by=(),
                medians=HOURLY_MEDIAN_METRICS, total: str = HOURLY_SUM_METRIC) -> DataFrame:
    """A1: one row per (hour, pop): exact median of each metric (missing
    removed) and the sum of counts, 0 when every count is missing (T4).

    A missing hour or population is a group of its own, and infinite values
    are values. What a group holds in memory is its distinct values, partially
    aggregated before the shuffle."""
    count_sum = F.coalesce(F.sum(total), F.lit(0).cast("bigint")).alias(total)
    return df.withColumn(time, floor_hour(time)).groupBy(*by, time, pop).agg(
        *[F.median(nan_to_null(c)).alias(c) for c in medians], count_sum)


def _strict_sum(c: str):
    """Sum that is NULL as soon as one input is NULL (R's sum without na.rm, T5)."""
    nulls = F.sum(F.when(F.col(c).isNull(), 1).otherwise(0))
    return F.when(nulls == 0, F.sum(c))


def ridgeline(df: DataFrame, x: str, by=(), date: str = "date", pop: str = "pop",
              sums=("n", "Qc_sum")) -> DataFrame:
    """A2: per (date, pop, x) the sums of ``n`` and ``Qc_sum``; a missing input
    makes its sum missing. A NULL ``x`` is its own group."""
    return df.groupBy(*by, date, pop, x).agg(*[_strict_sum(s).alias(s) for s in sums])


def extent(df: DataFrame, time: str = "time", pad_hours: int = 0, by=()) -> DataFrame:
    """A3: ``min(time)`` and ``max(time) + pad_hours`` (missing removed) per key."""
    hi = F.max(time)
    if pad_hours:
        hi = hi + F.expr(f"INTERVAL {int(pad_hours)} HOURS")
    aggs = [F.min(time).alias("time_min"), hi.alias("time_max")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def value_range(df: DataFrame, cols, by=()) -> DataFrame:
    """``{col}_min`` / ``{col}_max`` per key, NaN treated as missing."""
    aggs = []
    for c in cols:
        aggs += [F.min(nan_to_null(c)).alias(f"{c}_min"), F.max(nan_to_null(c)).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def time_points(df: DataFrame, time: str = "time", by=()) -> DataFrame:
    """The distinct time points (order at output with ``orderBy``)."""
    return df.select(*by, time).distinct()


def populations(df: DataFrame, pop: str = "pop", by=(), unknown: str = UNKNOWN_POP) -> DataFrame:
    """Distinct non-missing populations with the default selection flag:
    every population but ``unknown``, or all of them when nothing else exists."""
    each = df.where(F.col(pop).isNotNull()).groupBy(*by).agg(F.collect_set(pop).alias("__pops"))  # a few names
    known = F.exists("__pops", lambda p: p != unknown).alias("__known")
    out = each.select(*by, known, F.explode("__pops").alias(pop))
    return out.select(*by, pop, ((F.col(pop) != F.lit(unknown)) | ~F.col("__known")).alias("selected"))


def sfl_only_count(sfl: DataFrame, stat: DataFrame, time: str = "time", by=()) -> DataFrame:
    """A10 + G1: number of distinct SFL times absent from Stat (set difference,
    NULL equal to NULL). Both time columns are made TIMESTAMP first (T11)."""
    a = sfl.select(*by, F.col(time).cast("timestamp").alias(time))
    b = stat.select(*by, F.col(time).cast("timestamp").alias(time))
    only = a.subtract(b)
    return only.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else \
        only.agg(F.count(F.lit(1)).alias("n"))


def flags_present(sfl: DataFrame, stat: DataFrame, flag: str = "flag", by=()) -> DataFrame:
    """Distinct flags of both tables, missing dropped, as text (R's
    ``as.character`` of the numbers); ``flag_value`` keeps the numeric order."""
    a = sfl.select(*by, F.col(flag).cast("double").alias("flag_value"))
    b = stat.select(*by, F.col(flag).cast("double").alias("flag_value"))
    vals = a.union(b).where(F.col("flag_value").isNotNull() & ~F.isnan("flag_value")).distinct()
    return vals.withColumn(flag, flag_text("flag_value", vals.schema["flag_value"].dataType))


def series_arrays(df: DataFrame, x: str, height: str, keys=("pop", "date"), by=()) -> DataFrame:
    """One ordered series per (keys, pop, date) as two aligned arrays ``x`` and
    ``height``, sorted by x (one 3-D line each).

    A series holds one element per grid bin of ``x``, so its size is bounded
    by the grid resolution, not by the data volume.
    """
    pts = F.struct(F.col(x).alias("x"), F.col(height).alias("height"))
    keys = [*by, *keys]
    s = df.groupBy(*keys).agg(F.array_sort(F.collect_list(pts)).alias("__s"))
    return s.select(*keys, F.col("__s.x").alias("x"), F.col("__s.height").alias("height"))


def ordered(df: DataFrame, *cols: str) -> DataFrame:
    """O1: output order, missing values last (a full range-partitioned sort: use it on results only)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])
