"""Parameter plans as time intervals, and the joins against them.

A *plan* lists the moments a parameter set (filter or gating id) takes
effect. ``to_intervals`` turns it into half-open ``[start_date, end_date)``
rows; ``active_at`` / ``active_in_hour`` attach the interval(s) in force to
points or hours.

Scale design
------------
* No window or join ever puts a whole key (cruise) into one task. The lead
  over starts, and the as-of and hour joins of points with intervals that
  don't overlap (``disjoint``), are sweeps (``operators.sweep``): nothing is
  exploded, however long an interval is.
* Particle rows aren't moved for a plan that fits a broadcast, and intervals
  that overlap may match a point more than once. These joins are bucketed: each interval is exploded over the time buckets
  it covers, the probe side gets its bucket, and the join is an equi-join on
  ``(keys, bucket)`` with the exact range predicate as a join filter. An
  open-ended interval is exploded only up to the key's last plan boundary
  (``cap``); probes past it are clamped to ``cap``, which is exact because
  only open intervals can contain such probes.
* Intervals without length are in force at no point and are left out before. Where a plan is dense, buckets are
  narrower than an hour, about one for each interval: a probe row meets a few intervals, however many the plan has.
* The exploded interval side, and the parameters that it stands for (one row for each set of values, not for each
  interval), are broadcast only after their size is measured; otherwise the join is a sort-merge join on ``(keys,
  bucket)`` whose hot buckets AQE splits. Spark's own estimate is of compressed bytes, so it isn't asked there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytotide.operators.joins import broadcast_bound, broadcast_fits, materialize, plan_join, row_bytes, scalar_join, sized_broadcast
from cytotide.operators.sweep import PART, as_of, following, in_hours, placed

HOUR_MICROS = 3_600_000_000


def _bucket(c: Column, width_micros: int) -> Column:
    return F.floor(F.unix_micros(c) / F.lit(float(width_micros))).cast("long")


def _last_bucket(end: Column, width_micros: int) -> Column:
    """Bucket of the last instant strictly before ``end``."""
    return F.floor((F.unix_micros(end) - F.lit(1)) / F.lit(float(width_micros))).cast("long")


# --------------------------------------------------------------------------- W1 W2

def to_intervals(plan: DataFrame, start: str = "start_date", end: str = "end_date",
                 by=(), tiebreak=(), max_time=None) -> DataFrame:
    """W1 + W2: ``end = lead(start)`` in start order (NULL starts last), then the
    last row's missing end becomes ``max_time``.

    ``tiebreak`` orders rows with equal starts (the reference keeps file
    order; Spark needs an explicit, deterministic order). ``max_time`` is a
    Python datetime, a Column expression, or a DataFrame with the ``by`` keys
    and one ``max_time`` column (per-key caps, e.g. the last SFL time of each
    cruise). Rows are never dropped; a NULL start yields an interval that
    matches nothing. The lead is a sweep (``sweep.following``).
    """
    by, tiebreak = list(by), list(tiebreak)
    s = F.col(start)
    told = {"__o": s.isNull(), **{f"__o{i}": F.col(t).isNull() for i, t in enumerate(tiebreak)}}
    order = ["__o", start, *[c for i, t in enumerate(tiebreak) for c in (f"__o{i}", t)]]
    rows = following(placed(plan.withColumns(told), by, order), by, order, start, "__next")
    rows = rows.withColumn(end, F.when(s.isNotNull(), F.col("__next.value")))
    if max_time is not None:
        if isinstance(max_time, DataFrame):
            rows = plan_join(rows, max_time.select(*by, F.col("max_time").alias("__cap")), by)
            cap = F.col("__cap")
        else:
            cap = max_time if isinstance(max_time, Column) else F.lit(max_time)
        rows = rows.withColumn(end, F.when(F.col("__next").isNull(), cap.cast("timestamp")).otherwise(F.col(end)))
    return rows.drop(*told, "__next", "__cap", PART)


# --------------------------------------------------------------------------- J1 J2

def with_params(intervals: DataFrame, params: DataFrame, left: str = "filter_id",
                right: str = "id", by=()) -> DataFrame:
    """Plan rows LEFT JOIN parameter rows on ``left = right`` within the
    same keys ``by`` (cruise): ids of different cruises may collide. The right
    keys are dropped.

    One plan row may meet several parameter rows (gating: one per population).
    Both sides are plan-sized: Spark picks the join from its statistics. Not so with parameters that are nested
    (``quantile_sets``): statistics take arrays for far smaller than they are, so these are never broadcast.
    """
    by = list(by)
    clash = (set(params.columns) & set(intervals.columns)) - {left, right, *by}
    if clash:
        raise ValueError(f"parameter columns clash with plan columns: {sorted(clash)}")
    p = params.withColumnsRenamed({right: "__pid", **{k: f"__p_{k}" for k in by}})
    cond = [F.col(left) == F.col("__pid")] + [F.col(k) == F.col(f"__p_{k}") for k in by]
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in params.schema.fields):
        p = p.hint("merge")
    return intervals.join(p, _and(cond), "left").drop("__pid", *[f"__p_{k}" for k in by])


# --------------------------------------------------------------------------- J5 J6

#: An interval table is exploded to about so many rows per interval, and a few
#: more; beyond, its buckets are widened by this factor until it is.
EXPLODE_PER_INTERVAL = 16
EXPLODE_LEAST = 100_000
WIDER = 16
#: Narrower buckets, by this factor each, are taken as long as the table has about so many rows per interval.
NARROWER, NARROW_STEPS = 4, 8
NARROW_PER_INTERVAL = 2
NARROW_LEAST = 1000


def _bucket_width(iv: DataFrame, start: str, end: str, width_micros: int, points: bool = False) -> tuple[int, int]:
    """The bucket width at which the explode stays in proportion to the number of
    intervals: ``width_micros``, more where intervals are long, less for a dense plan if ``points``, not
    whole hours, are to be found. And the measured bytes that it then has at most. Any width gives the same join; wider buckets compare more
    intervals per probe."""
    narrow = [w for k in range(NARROW_STEPS if points else 0, 0, -1) if (w := width_micros // NARROWER ** k) > 0]
    widths = narrow + [width_micros * WIDER ** k for k in range(8)]
    latest = iv.agg(F.max(F.greatest(start, end)).alias("__latest"))
    upto = F.coalesce(F.col(end), F.col("__latest"))
    spans = [F.sum(F.greatest(_last_bucket(upto, w) - _bucket(F.col(start), w), F.lit(0)) + F.lit(1.0)) for w in widths]
    n, widest, *rows = scalar_join(iv, latest).agg(F.count(F.lit(1)), F.max(row_bytes(iv)), *spans).first()
    rows = [int(r or 0) for r in rows]
    most = EXPLODE_PER_INTERVAL * n + EXPLODE_LEAST
    few = NARROW_PER_INTERVAL * n + NARROW_LEAST
    at = next((i for i, r in enumerate(rows) if r <= (few if i < len(narrow) else most)), len(rows) - 1)
    return widths[at], rows[at] * ((widest or 0) + 8)


def _explode_intervals(intervals: DataFrame, start: str, end: str, by: list[str],
                       bucket_micros: int, points: bool = False):
    """Intervals (written before, with row id ``__iv``) exploded over the
    buckets they cover: keys, bounds and id only.

    Returns ``(exploded, caps, width, size)``: ``caps`` has the last bucket
    of each key; size bounds the bytes of the exploded table.
    """
    s, e = F.col(start), F.col(end)
    iv = intervals.select(*by, start, end, "__iv").where(s.isNotNull())
    width, size = _bucket_width(iv, start, end, bucket_micros, points)
    iv = iv.withColumn("__b0", _bucket(s, width)) \
           .withColumn("__b1", F.when(e.isNotNull(), F.greatest(F.col("__b0"), _last_bucket(e, width))))
    cap_expr = F.greatest(F.max("__b0"), F.max("__b1")).alias("__cap")
    caps = iv.groupBy(*by).agg(cap_expr) if by else iv.agg(cap_expr)
    exploded = plan_join(iv, caps, by).withColumn("__b", F.explode(F.sequence("__b0", F.coalesce("__b1", "__cap"))))
    return exploded.drop("__b0", "__b1", "__cap"), caps, width, size


def _bucketed_range_join(probe: DataFrame, intervals: DataFrame, probe_time: Column,
                         cond_fn, start: str, end: str, by, how: str,
                         bucket_micros: int, points: bool = False) -> DataFrame:
    """Equi-join on (keys, bucket) plus the exact range predicate.

    Columns are matched by unique names (the interval side's keys are
    renamed), so probe and plan may even come from the same source table.
    """
    by = list(by)
    clash = (set(intervals.columns) & set(probe.columns)) - set(by)
    if clash:
        raise ValueError(f"interval columns clash with probe columns: {sorted(clash)}")
    payload = [c for c in intervals.columns if c not in {*by, start, end}]
    # An id carries the other columns (parameters) past the explode; intervals with equal ones share it. The hash skips
    # nulls, so it takes which columns are null as well.
    nulls = [F.col(c).isNull() for c in payload]
    intervals = materialize(intervals.withColumn("__iv", F.xxhash64(F.lit(0), *payload, *nulls)))
    iv, caps, width, size = _explode_intervals(intervals, start, end, by, bucket_micros, points)
    fits = size <= broadcast_bound(probe)
    if by:
        p = probe.join(F.broadcast(caps) if fits else caps, on=by, how="left")
    else:
        p = plan_join(probe, caps, by)
    p = p.withColumn("__pb", F.least(_bucket(probe_time, width), F.col("__cap"))) \
         .drop("__cap")
    right = iv.withColumnsRenamed({k: f"__r_{k}" for k in by})
    right = F.broadcast(right) if fits else right.hint("merge")
    cond = [F.col("__pb") == F.col("__b")] + [F.col(k) == F.col(f"__r_{k}") for k in by]
    joined = p.join(right, on=_and(cond + [cond_fn()]), how=how)
    joined = joined.drop("__pb", "__b", *[f"__r_{k}" for k in by])
    if payload:
        carried = intervals.select("__iv", *payload).dropDuplicates(["__iv"])
        joined = joined.join(F.broadcast(carried) if broadcast_fits(carried) else carried.hint("merge"), on="__iv", how="left")
    return joined.select(*probe.columns, start, end, *payload)


def _and(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def active_at(points: DataFrame, intervals: DataFrame, time: str = "time",
              start: str = "start_date", end: str = "end_date", by=(), how: str = "left",
              bucket_micros: int = HOUR_MICROS, disjoint: bool = False, distinct: bool = False) -> DataFrame:
    """Attach the interval in force at each point:
    ``start <= time AND (end IS NULL OR time < end)``.

    ``how='left'`` keeps points with no interval (interval columns NULL).
    Intervals from ``to_intervals`` never overlap, so each point gets at most
    one row: say so with ``disjoint``, and the join is a sweep over the distinct
    points, joined back to ``points``, as these may have other columns or repeat. Say ``distinct`` where they don't
    (keys and time only, none twice): an inner join then is the sweep alone.
    Without it, a point gets a row for every interval in force; use
    ``last_match`` afterwards (W3).
    """
    if disjoint:
        keys = [*by, time]
        clash = (set(intervals.columns) & set(points.columns)) - set(by)
        if clash:
            raise ValueError(f"interval columns clash with probe columns: {sorted(clash)}")
        hit = as_of(points, intervals, time, start, end, by)
        if distinct and how == "inner" and set(points.columns) == set(keys):
            return hit.select(*points.columns, *[c for c in hit.columns if c not in keys])
        hit = hit.withColumnsRenamed({k: f"__h_{k}" for k in keys})
        # a null key is a key of its own here as in the sweep
        same = _and([F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys])
        return points.join(hit, same, how).drop(*[f"__h_{k}" for k in keys])

    def cond():
        t, s, e = F.col(time), F.col(start), F.col(end)
        return (s <= t) & (e.isNull() | (t < e))
    lasting = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))
    return _bucketed_range_join(points, intervals.where(lasting), F.col(time), cond, start, end, by, how,
                                bucket_micros, points=True)


def active_in_hour(hours: DataFrame, intervals: DataFrame, hour: str = "hour",
                   start: str = "start_date", end: str = "end_date", by=(),
                   how: str = "inner", disjoint: bool = False) -> DataFrame:
    """Every interval overlapping the UTC hour ``[hour, hour + 1h)``:
    ``start < hour_end AND (end IS NULL OR end > hour)``. Many per hour allowed.
    ``disjoint``: no two intervals overlap, ``hours`` are whole and distinct (an inner join by sweep)."""
    if disjoint:
        if how != "inner" or set(hours.columns) != {*by, hour}:
            raise ValueError("disjoint joins distinct hours (keys and hour only), inner")
        return in_hours(hours, intervals, hour, start, end, by)

    def cond():
        h, s, e = F.col(hour), F.col(start), F.col(end)
        return (s < h + F.expr("INTERVAL 1 HOUR")) & (e.isNull() | (e > h))
    return _bucketed_range_join(hours, intervals, F.col(hour), cond, start, end, by, how,
                                HOUR_MICROS)


# --------------------------------------------------------------------------- W3 D2 J7 J10

def last_match(df: DataFrame, keys, order: str = "start_date", carry=None) -> DataFrame:
    """Per point key keep the matched row with the latest ``order`` value
    (the reference's ``slice_tail(n = 1)`` over a start-sorted plan).

    ``carry`` lists the columns to keep from the winning row (default: all
    non-key columns). Aggregates with ``max_by`` (partial aggregation, one
    row per key in memory), never a per-key collect.
    """
    keys = list(keys)
    carry = [c for c in (carry or df.columns) if c not in keys]
    won = df.groupBy(*keys).agg(F.max_by(F.struct(*carry), F.col(order)).alias("__w"))
    return won.select(*keys, *[F.col(f"__w.{c}").alias(c) for c in carry])


def conflicting_gates(active: DataFrame, point_cols, id_col: str = "gating_id",
                      start: str = "start_date") -> DataFrame:
    """Points with more than one active parameter id (a NULL id counts as one).

    Only matched rows (non-NULL start) count. Returns ``point_cols`` plus
    ``n_active``; an empty result means the single-gate rule holds.
    """
    matched = active.where(F.col(start).isNotNull())
    n = F.countDistinct(id_col) + F.max(F.when(F.col(id_col).isNull(), 1).otherwise(0))
    return matched.groupBy(*point_cols).agg(n.alias("n_active")).where(F.col("n_active") > 1)


def active_rows(df: DataFrame, active: DataFrame, keys, active_keys=None) -> DataFrame:
    """Rows of ``df`` whose key(s) appear among the active ones (semi join).

    NULL ids never match. ``active_keys`` renames the active side's columns to
    ``keys`` when they differ (e.g. plan ``gating_id`` vs gating ``id``).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    akeys = keys if active_keys is None else ([active_keys] if isinstance(active_keys, str)
                                              else list(active_keys))
    ids = active.select(*[F.col(a).alias(k) for a, k in zip(akeys, keys)]).dropna().distinct()
    # ``df`` may be particle data: the id list is measured before broadcasting.
    return df.join(sized_broadcast(ids), on=keys, how="left_semi")
