"""Sweeps over a global order: running values carried from partition to partition (J5 J6 D2 W1 for plans of any size).

Spark has no distributed running aggregate: a window without keys, or with one
huge key, is one task. Here rows are range-partitioned by (keys, order) and
written once, each with its partition's number. Then a value runs

1. across partitions: a window over the summary, one row per (keys,
   partition). Partitions are ranges, so nearly all keys have one row there,
   and a key has at most as many as there are partitions. What it finds joins
   the rows of its partition as a row of its own,
2. and then within (keys, partition): a window over at most one partition's rows.

However long an interval is and whatever its keys, a row is moved once or
twice; nothing is exploded, and no broadcast is forced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytotide.operators.joins import materialize

PART = "__part"


def placed(df: DataFrame, by, order) -> DataFrame:
    """``df`` range-partitioned by keys and order columns, with its partition's number; written once.
    Rows equal in all of them share a partition, so ``order`` should tell heavy repeats apart."""
    return materialize(df.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()))


#: Set in rows; null in those that only bring a partition what others hand to it.
ROW = "__s_row"


def _entered(df: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows, and with them what enters their partition, a row of its own for each keys and partition. The window
    takes both in one shuffle; a join after it, of keys that may be null, would move every row again."""
    return df.withColumn(ROW, F.lit(1)).unionByName(entries, allowMissingColumns=True)


def _left(df: DataFrame) -> DataFrame:
    """The rows without those of ``_entered``."""
    return df.where(F.col(ROW).isNotNull()).drop(ROW)


def carried(df: DataFrame, by, order, values: dict[str, str]) -> DataFrame:
    """The last values that aren't null up to each row (its own included), per keys, in the order of the
    columns. ``values`` has the new column of each; all are null in the same rows. ``df`` is ``placed`` by the same columns."""
    inside = Window.partitionBy(*by, PART).orderBy(F.col(ROW).asc_nulls_first(), *order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    have = F.col(next(iter(values))).isNotNull()
    last = F.max_by(F.when(have, F.struct(*values)), F.when(have, F.struct(*order)))
    entries = (df.groupBy(*by, PART).agg(last.alias("__s_last"))
               .select(*by, PART, F.last("__s_last", ignorenulls=True).over(before).alias("__s_carry"))
               .where("__s_carry is not null").select(*by, PART, "__s_carry.*"))
    return _left(_entered(df, entries).withColumns({out: F.last(v, ignorenulls=True).over(inside) for v, out in values.items()}))


def following(df: DataFrame, by, order, value: str, out: str) -> DataFrame:
    """``value`` of the next row, per keys, in the order of the columns, in a struct; null for the last. ``df`` is
    ``placed`` by the same columns."""
    inside = Window.partitionBy(*by, PART).orderBy(F.col(ROW).asc_nulls_last(), *order)
    after = Window.partitionBy(*by).orderBy(PART)
    first = F.min(F.struct(*[F.struct(F.col(o).isNotNull().alias("told"), F.col(o).alias("at")).alias(f"o{i}") for i, o in enumerate(order)],
                           F.col(value).alias("value"))).alias("__s_first")
    entries = (df.groupBy(*by, PART).agg(first).select(*by, PART, F.lead("__s_first").over(after).alias("__s_next"))
               .where("__s_next is not null").select(*by, PART, F.col("__s_next.value").alias(value)))
    rows = _left(_entered(df, entries).withColumns({"__s_value": F.lead(value).over(inside), "__s_more": F.lead(F.lit(1)).over(inside)}))
    told = F.when(F.col("__s_more").isNotNull(), F.struct(F.col("__s_value").alias("value")))
    return rows.withColumn(out, told).drop("__s_value", "__s_more")


def running_sum(df: DataFrame, by, order, value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to each row (its own included), per keys, in the order of the columns. ``df`` is
    ``placed`` by the same columns, and no two rows are equal in all of them."""
    inside = Window.partitionBy(*by, PART).orderBy(F.col(ROW).asc_nulls_first(), *order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    entries = (df.groupBy(*by, PART).agg(F.sum(value).alias("__s_sum"))
               .select(*by, PART, F.sum("__s_sum").over(before).alias(value)).where(F.col(value).isNotNull()))
    return _left(_entered(df, entries).withColumn(out, F.sum(value).over(inside)))


# --------------------------------------------------------------------------- J5 J6

def as_of(points: DataFrame, intervals: DataFrame, time: str = "time", start: str = "start_date", end: str = "end_date",
          by=()) -> DataFrame:
    """J5 for intervals that don't overlap (as ``to_intervals`` makes them): each distinct point (keys and
    ``time``) with the interval in force there, and only points that have one.

    Points and interval starts are swept in one order; the last start up to a
    point carries its interval, which holds if its end lies beyond the point.
    """
    by = list(by)
    lasting = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))
    # of repeated starts the longest interval is the one in force; an open end is the longest
    far = F.coalesce(F.unix_micros(end), F.lit(2 ** 63 - 1))
    # each time is written once: the start is the row's time, the end its order
    rest = F.struct(F.col(end).isNull().alias("__open"), *[c for c in intervals.columns if c not in {*by, start, end}])
    iv = intervals.where(lasting).select(*by, F.col(start).alias("__t"), F.lit(0).alias("__kind"), far.alias("__far"), rest.alias("__rest"))
    pts = (points.select(*by, F.col(time).alias("__t")).where("__t is not null").distinct()
           .select(*by, "__t", F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__far"), F.lit(None).cast(iv.schema["__rest"].dataType).alias("__rest")))
    order = ["__t", "__kind", "__far"]
    events = placed(iv.unionByName(pts), by, order).withColumn("__start", F.when(F.col("__kind") == 0, F.col("__t")))
    swept = carried(events, by, order, {"__start": "__from", "__far": "__upto", "__rest": "__hit"}).where("__kind = 1 and __hit is not null")
    types = {f.name: f.dataType for f in intervals.schema.fields}
    known = {start: F.col("__from").cast(types[start]), end: F.when(~F.col("__hit.__open"), F.timestamp_micros("__upto")).cast(types[end])}
    held = F.col("__hit.__open") | (F.col("__t") < known[end])
    payload = [c for c in intervals.columns if c not in by]
    return (swept.where(held)
            .select(*by, F.col("__t").alias(time), *[known.get(c, F.col(f"__hit.{c}")).alias(c) for c in payload]))


def in_hours(hours: DataFrame, intervals: DataFrame, hour: str = "hour", start: str = "start_date", end: str = "end_date",
             by=()) -> DataFrame:
    """J6 for intervals that don't overlap: each distinct hour (keys and ``hour``) with every interval that has
    a part in it. These are the one in force as the hour begins, and those that start later in it."""
    by = list(by)
    hours = hours.select(*by, hour).distinct()
    running = as_of(hours, intervals, hour, start, end, by)
    begun = intervals.withColumn("__hour", F.date_trunc("hour", start)).where((F.col(start) > F.col("__hour")) & (F.col(end).isNull() | (F.col(end) > F.col("__hour"))))
    keys = [F.col(f"__h_{k}").eqNullSafe(F.col(k)) for k in by]
    later = hours.withColumnsRenamed({k: f"__h_{k}" for k in by}).join(begun, reduce(lambda a, b: a & b, [F.col(hour) == F.col("__hour"), *keys]))
    return running.unionByName(later.select(*running.columns))


# --------------------------------------------------------------------------- D2

def active_ids(points: DataFrame, intervals: DataFrame, id_col: str = "gating_id", time: str = "time", start: str = "start_date",
               end: str = "end_date", by=()) -> DataFrame:
    """How many different ids (a missing one counts as an id) are active at each distinct point, ``n_active``;
    only points with any. Intervals may overlap in any way.

    A sweep line: per id, interval ends add and take away one; where an id's
    sum leaves or returns to zero, the id begins or ends (gaps and islands).
    Those events, swept with the points, count the ids: no active pair is listed.
    """
    by = list(by)
    iv = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    one = lambda t, n: iv.select(*by, F.col(id_col).alias("__id"), F.col(t).alias("__t"), F.lit(n).alias("__d")).where("__t is not null")
    steps = (one(start, 1).unionByName(one(end, -1)).groupBy(*by, "__id", "__t").agg(F.sum("__d").cast("long").alias("__d")).where("__d <> 0"))
    runs = running_sum(placed(steps, [*by, "__id"], ["__t"]), [*by, "__id"], ["__t"], "__d", "__n")
    turn = F.when(F.col("__n") == F.col("__d"), 1).when(F.col("__n") == 0, -1)
    turns = runs.select(*by, "__t", turn.cast("long").alias("__d")).where("__d is not null").groupBy(*by, "__t").agg(F.sum("__d").alias("__d"))
    pts = points.select(*by, F.col(time).alias("__t")).where("__t is not null").distinct().select(*by, "__t", F.lit(0).cast("long").alias("__d"))
    # what begins or ends at a point's time counts there: intervals hold their start and not their end
    events = (turns.withColumn("__kind", F.lit(0)).unionByName(pts.withColumn("__kind", F.lit(1))))
    swept = running_sum(placed(events, by, ["__t", "__kind"]), by, ["__t", "__kind"], "__d", "n_active")
    return swept.where("__kind = 1 and n_active > 0").select(*by, F.col("__t").alias(time), "n_active")


def gate_conflicts(points: DataFrame, intervals: DataFrame, id_col: str = "gating_id", time: str = "time", start: str = "start_date",
                   end: str = "end_date", by=()) -> DataFrame:
    """Points with more than one active id; an empty result means that the single-gate rule holds."""
    return active_ids(points, intervals, id_col, time, start, end, by).where("n_active > 1")
