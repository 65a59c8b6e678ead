"""The reference's data flows (Q1-Q11), batched over every key at once.

The reference answers for one cruise and one selected time point; here each
flow computes the answer for every cruise / hour / point at once (small
sides are measured and materialised first, then one job over the data). A
single selection is the same flow followed by a filter (``at=``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.functions.columns import BEAD_PANEL_CHANNELS, BEAD_PANEL_LABELS
from cytotide.functions.numeric import untransform
from cytotide.functions.time import floor_hour, iso_text, parse_time
from cytotide.operators.aggregates import hourly_stat, populations, ridgeline, series_arrays
from cytotide.operators.density import hex_counts_panels, log_bin_counts_pairs, rescale
from cytotide.operators.filters import (DEFAULT_EXCLUDED_FLAGS, aligned, exclude_flags, in_range,
                                        keep_pops, plottable, valid_segments)
from cytotide.operators.gating import gate_centroids, gate_outlines
from cytotide.operators.intervals import active_at, active_in_hour, to_intervals, with_params
from cytotide.operators.joins import materialize, sized_broadcast
from cytotide.operators.opp import select_opp
from cytotide.sources.tables import sfl_series, stat_series

# Fixed values from the reference.
SFL_METRICS = ("par", "ocean_tmp", "salinity", "conductivity", "lat", "lon", "stream_pressure",
               "event_rate")
STAT_METRICS = ("abundance", "diameter", "fsc_med", "chl_med", "pe_med", "n_count",
                "opp_evt_ratio")
FILTER_PARAM_SERIES = ("beads_fsc_small", "beads_D1", "beads_D2")
GATING_CHANNEL_PAIRS = (("fsc_small", "pe"), ("fsc_small", "chl_small"), ("chl_small", "pe"))
BEAD_CHANNELS = ("D1", "D2", "fsc_small", "chl_small", "pe")


# ---------------------------------------------------------------- Q3 Q4 Q11

def sfl_metrics(sfl: DataFrame, flags=DEFAULT_EXCLUDED_FLAGS, by=()) -> DataFrame:
    """Q3: SFL series with flag exclusion (all eight metrics)."""
    return exclude_flags(sfl_series(sfl, by=by), flags)


def stat_metrics(stat: DataFrame, flags=DEFAULT_EXCLUDED_FLAGS, pops=None, hourly: bool = False,
                 by=()) -> DataFrame:
    """Q4: Stat series (quantile 50) with flag exclusion, optional population
    filter, raw or aggregated per hour."""
    df = exclude_flags(stat_series(stat, by=by), flags)
    if pops is not None:
        df = keep_pops(df, pops)
    return hourly_stat(df, by=by) if hourly else df


# ---------------------------------------------------------------- Q5

def filter_intervals(plan: DataFrame, params: DataFrame, max_time=None, by=(),
                     tiebreak=("filter_id",)) -> DataFrame:
    """W1 + W2 + J1: filter plan intervals with their (quantile-50) parameters.

    Start dates may be timestamps, epoch seconds or text (F2, decided per
    column and key, as the reference reads them)."""
    plan = parse_time(plan, "start_date", mode="column", by=list(by))
    iv = to_intervals(plan, by=by, tiebreak=tiebreak, max_time=max_time)
    return with_params(iv, params, left="filter_id", right="id", by=by)


def gating_intervals(plan: DataFrame, max_time=None, by=(), tiebreak=("gating_id",)) -> DataFrame:
    """W1 + W2 for the gating plan, start dates read like the filter plan's."""
    plan = parse_time(plan, "start_date", mode="column", by=list(by))
    return to_intervals(plan, by=by, tiebreak=tiebreak, max_time=max_time)


def filter_param_segments(intervals: DataFrame, series=FILTER_PARAM_SERIES, by=()) -> DataFrame:
    """Q5: step segments ``(param, start_date, end_date, y_value)`` for the
    bead position parameters; incomplete segments dropped."""
    pairs = ", ".join(f"'{s}', `{s}`" for s in series)
    long = intervals.select(*by, "filter_id", "start_date", "end_date",
                            F.expr(f"stack({len(series)}, {pairs}) AS (param, y_value)"))
    return valid_segments(long)


# ---------------------------------------------------------------- J5 at points

def params_at_points(points: DataFrame, intervals: DataFrame, time: str = "time", by=(),
                     dedupe: bool = True) -> DataFrame:
    """J5 (+ W3): parameters in force at each distinct time point. Intervals of a plan don't overlap,
    so a sweep finds the one; ``dedupe=False`` lists every match of intervals that may overlap."""
    pts = points.select(*by, time).distinct()
    return active_at(pts, intervals, time=time, by=by, disjoint=dedupe)


# ---------------------------------------------------------------- Q1 Q6

def attach_params(particles: DataFrame, intervals: DataFrame, time: str = "time", by=(),
                  anchors: DataFrame | None = None) -> DataFrame:
    """Parameters for each particle.

    ``anchors=None``: the interval in force at the particle's own time.
    Otherwise ``anchors`` has ``by`` keys, ``hour`` and ``anchor_time`` (one
    selected point per hour, the reference's selection): every particle of
    that hour gets the parameters in force at the selected point, even if
    the plan changes inside the hour. The anchor table is hour-sized.
    """
    if anchors is None:
        return active_at(particles, intervals, time=time, by=by, how="left")
    at = active_at(anchors, intervals, time="anchor_time", by=by, how="left", disjoint=True).drop("anchor_time")
    p = particles.withColumn("hour", floor_hour(time))
    return p.join(sized_broadcast(at), on=[*by, "hour"], how="left")


def opp_selection(particles: DataFrame, intervals: DataFrame, anchor: str = "row",
                  anchors: DataFrame | None = None, time: str = "time", by=(), quantiles=None) -> DataFrame:
    """Q1: particles passing the filter whose parameters are in force.

    ``quantiles``: with intervals that carry ``quantile_sets``, all of them in one pass, a flag each.

    ``anchor='row'``: at each particle's own time. ``anchor='selected'``:
    at the selected point of the particle's hour (``anchors``: keys, ``hour``,
    ``anchor_time``), for the whole hour — the reference's behaviour.
    """
    if anchor == "selected":
        if anchors is None:
            raise ValueError("anchor='selected' needs an anchors frame (keys, hour, anchor_time)")
        attached = attach_params(particles, intervals, time=time, by=by, anchors=anchors).drop("hour")
    elif anchor == "row":
        attached = attach_params(particles, intervals, time=time, by=by)
    else:
        raise ValueError(f"anchor must be 'row' or 'selected', not {anchor!r}")
    return select_opp(attached, quantiles)


def bead_density(particles: DataFrame, kind: str = "evt", by=(), align: bool = True,
                 free_y: bool = True, time: str = "time") -> DataFrame:
    """Q6: hexagon counts of the four bead panels per (keys, hour).

    ``particles`` carry their active filter parameters (``attach_params``).
    ``kind='evt'``: all bead events, with the optional alignment filter;
    ``'opp'``: events passing the filter (Q1); ``'vct'``: true OPP, VCT rows
    whose ``filter_id`` is the active one (J10), moved to the 16-bit log scale
    (F12).
    """
    df = particles.withColumn("hour", floor_hour(time)) if "hour" not in particles.columns else particles
    if kind == "evt":
        if align:
            df = df.where(F.coalesce(aligned("D1", "D2", "width"), F.lit(False)))
    elif kind == "opp":
        df = select_opp(df)
    elif kind == "vct":
        df = df.where(F.col("filter_id") == F.col("active_filter_id"))
        df = untransform(df, list(BEAD_CHANNELS))
    else:
        raise ValueError(f"kind must be evt, opp or vct, not {kind!r}")
    return hex_counts_panels(df, BEAD_PANEL_CHANNELS, BEAD_PANEL_LABELS, by=[*by, "hour"], free_y=free_y)


# ---------------------------------------------------------------- Q7 Q8

def gating_cytograms(vct: DataFrame, scope: str = "hour", by=(), pairs=GATING_CHANNEL_PAIRS,
                     time: str = "time") -> DataFrame:
    """Q7: log-scale 2-D counts per population for each channel pair, per
    time point (``scope='point'``) or hour."""
    key = floor_hour(time).alias("scope_time") if scope == "hour" else F.col(time).alias("scope_time")
    df = vct.select("*", key)
    return log_bin_counts_pairs(df, list(pairs), by=[*by, "scope_time"])


def gating_outlines(gating: DataFrame, poly: DataFrame, pairs=GATING_CHANNEL_PAIRS, by=()) -> DataFrame:
    """Q7: polygon outlines (vertex rows) for every channel pair; labels come
    from ``gating_centroids``."""
    return gate_outlines(gating, poly, pairs, by=by)


def gating_centroids(outlines: DataFrame, by=()) -> DataFrame:
    """A4 per channel pair."""
    return gate_centroids(outlines, keys=("pair", "gating_id", "pop"), by=by)


def active_gating(scope_rows: DataFrame, intervals: DataFrame, gating: DataFrame,
                  scope: str = "point", time: str = "time", by=()) -> DataFrame:
    """Q8: active gating plan rows joined to their gating definitions, with
    ISO-text dates; per point (``time``) or per hour (``hour``)."""
    if scope == "hour":
        hours = scope_rows.select(*by, floor_hour(time).alias("hour")).distinct()
        act = active_in_hour(hours, intervals, by=by, disjoint=True)
    else:
        pts = scope_rows.select(*by, time).distinct()
        act = active_at(pts, intervals, time=time, by=by, how="inner", disjoint=True, distinct=True)
    joined = with_params(act, gating, left="gating_id", right="id", by=by)
    return joined.withColumns({"start_date": iso_text("start_date"), "end_date": iso_text("end_date")})


#: Vertices and scope values of a gate that are put together, about; of the latter so many meet at a time, exactly (but
#: for a rest), as files store sequences that begin at whole bytes far smaller; rows that a task makes, and most tasks.
POLYGON_VERTICES, POLYGON_SCOPES, POLYGON_SLICE = 128, 4096, 512
POLYGON_TASK_ROWS, POLYGON_TASKS = 2_000_000, 4000
#: More partitions than any frame has: what is coalesced to so many keeps its own.
AS_MANY = 1_000_000


def active_polygons(poly: DataFrame, active: DataFrame, scope: str = "time", by=()) -> DataFrame:
    """Polygon vertices of the gating ids active at each point (``scope='time'``)
    or in each hour (``'hour'``), with that scope. Missing ids match nothing.

    A gate's result is all its vertices at all its scope values, so it grows with their product. Both sides are
    packed into arrays of bounded size (a heavy gate has many), each pack of vertices meets each pack of scope values
    of its gate in a cell of their own, and cells, not gates or packs, are dealt to tasks and unpacked as they are
    returned: nothing of the result's size is shuffled, sorted or held, no task's share grows with a gate, and the
    columns are long runs and short repeated sequences, which files store in little space. A result beyond what the
    most tasks make has larger cells, not more.
    """
    keys = [*by, "gating_id"]
    ids = materialize(active.select(*by, scope, "gating_id").dropna().distinct())
    vertices = materialize(poly.dropna(subset=keys).withColumn("__no", F.monotonically_increasing_id()))
    n_ids, n_vertices = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((ids, "__n"), (vertices, "__m")))
    gates = sized_broadcast(n_ids.join(n_vertices, keys).withColumn("__gate", F.monotonically_increasing_id()))
    rows = gates.agg(F.sum(F.col("__n").cast("double") * F.col("__m"))).first()[0] or 0
    tasks = int(min(rows // POLYGON_TASK_ROWS + 1, POLYGON_TASKS))
    wider = math.ceil(math.sqrt(max(1, rows / (POLYGON_TASKS * POLYGON_TASK_ROWS))))
    packs = {"__vs": F.ceil(F.col("__m") / (POLYGON_VERTICES * wider)), "__ss": F.ceil(F.col("__n") / (POLYGON_SCOPES * wider))}
    cell = ["__gate", "__v", "__s"]

    def packed(df, told, values, out, at, n, other, others):
        """A row for each cell that a pack is in: all that it shares with packs of the other side."""
        some = df.join(gates, keys).withColumns(packs).withColumn(at, F.pmod(F.xxhash64(told), F.col(n)))
        together = some.groupBy("__gate", at, others).agg(F.collect_list(values).alias(out))
        return together.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))).drop(others)

    left = packed(vertices, "__no", F.struct(*poly.columns), "__vertices", "__v", "__vs", "__s", "__ss")
    right = packed(ids, scope, F.col(scope), "__scopes", "__s", "__ss", "__v", "__vs")
    # statistics take arrays for far smaller than they are, so neither side is broadcast by them
    met = left.repartition(tasks, *cell).join(right.repartition(tasks, *cell).hint("merge"), cell)
    slices = F.expr(f"transform(sequence(0, (size(__scopes) - 1) div {POLYGON_SLICE}), i -> slice(__scopes, int(i * {POLYGON_SLICE} + 1), {POLYGON_SLICE}))")
    some = met.select("__vertices", F.explode(slices).alias("__scopes"))
    # generated code holds all rows that it makes of one before it hands them on: it ends here, so that they are a slice's, not a pack's
    each = some.select(F.inline("__vertices"), "__scopes").coalesce(AS_MANY)
    columns = [*keys, *[c for c in poly.columns if c not in keys]]
    return each.select(*columns, F.explode("__scopes").alias(scope))


# ---------------------------------------------------------------- Q9 Q10

def select_pops(df: DataFrame, pops, pop: str = "pop", by=()) -> DataFrame:
    """P4 with the reference's default: ``pops='default'`` keeps the A8 default
    selection computed from the data (all populations but 'unknown', or all
    when nothing else exists) via a semi join; a list keeps those; None keeps all."""
    if pops is None:
        return df
    if isinstance(pops, str) and pops == "default":
        # written once: the flows read the data again for ranges, but not the populations
        chosen = sized_broadcast(populations(df, pop=pop, by=by).where(F.col("selected")).select(*by, pop))
        return df.join(chosen, on=[*by, pop], how="left_semi")
    return keep_pops(df, pops, pop)


def gridded_scatter(decoded: DataFrame, x: str = "fsc_small", y: str = "chl_small", z: str = "pe",
                    size: str = "n", pops="default", log_axes=(True, True, True), by=()) -> DataFrame:
    """Q9: gridded rows per hour for a 3-D scatter: selected populations,
    all four columns present, log axes positive, marker size rescaled to
    3..18 within each hour (10 when flat)."""
    df = select_pops(decoded.withColumn("hour", floor_hour("date")), pops, by=by)
    logs = [c for c, on in zip((x, y, z), log_axes) if on]
    df = plottable(df, [x, y, z, size], logs)
    return rescale(df, size, by=[*by, "hour"])


def ridgeline_flow(decoded: DataFrame, x: str = "fsc_small", pops="default", start=None, end=None,
                   per_hour: bool = True, by=()) -> DataFrame:
    """Q10: ridgeline sums per (date, pop, x).

    ``per_hour=True`` is the reference's selected-hour mode for every hour at
    once (each gridded hour is its own window, clamped to the data extent).
    Otherwise ``[start, end)`` is a manual range. Clamping it to the extent
    ``[min date, max date + 1h)`` (A3 + F6) removes no row, as every date is
    inside its own extent, so the range is a plain predicate on ``date``.
    """
    df = select_pops(decoded, pops, by=by)
    if not per_hour:
        df = df.where(F.col("date").isNotNull())
        df = in_range(df, start if start is not None else "0001-01-01 00:00:00",
                      end if end is not None else "9999-12-31 23:59:59", col="date")
    return ridgeline(df, x, by=by)


def ridgeline_series(sums: DataFrame, x: str = "fsc_small", height: str = "Qc_sum", by=()) -> DataFrame:
    """One ordered 3-D line per (keys, pop, date)."""
    return series_arrays(sums, x, height, by=by)
