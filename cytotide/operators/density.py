"""2-D density counts and rescaling.

Bin rules (ours; plotting-library internals are not part of the reference,
so exact cell parity with a plotting package is not claimed):

* Rectangular log bins (A6): ``lo = min(log10 v)``, ``w = (max - min) / bins``,
  ``i = least(floor((log10 v - lo) / w), bins - 1)``; a flat range puts
  every value in bin 0.
* Hexagonal bins (A5), the two-lattice rule of Carr et al. (1987):
  ``u = (x - x0) / wx``, ``v = (y - y0) / (sqrt(3) * wy)`` with
  ``w = (max - min) / bins``; candidate centres ``(round u, round v)`` on
  lattice 0 and ``(floor u + 1/2, floor v + 1/2)`` on lattice 1; the one with
  the smaller ``du^2 + 3 dv^2`` wins, ties to lattice 0.

Ranges come from one grouped aggregate joined back on the scope keys
(broadcast when measured small, else a shuffle join that AQE splits on hot
keys); the counts are a partially aggregated groupBy. No global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.functions.numeric import is_finite
from cytotide.operators.joins import broadcast_fits, keyed_join, materialize, plan_join

# Fixed values from the reference.
BEAD_HEX_BINS = 110
CYTOGRAM_BINS = 140
# Population levels of the cytogram colour scale; other labels become NULL.
POP_LEVELS = ("unknown", "beads", "prochloro", "synecho", "picoeuk", "croco")
SQRT3 = 1.7320508075688772


def _width(lo: str, hi: str, bins: int):
    return F.when(F.col(hi) > F.col(lo), (F.col(hi) - F.col(lo)) / F.lit(float(bins))) \
        .otherwise(F.lit(1.0))


def _present(keys) -> list:
    """Scope keys must be there: rows without a time are in no hour, as the reference's hour filter has it."""
    return [F.col(k).isNotNull() for k in keys]


def _where(df: DataFrame, conds) -> DataFrame:
    for c in conds:
        df = df.where(c)
    return df


def _count_cells(pts: DataFrame, x: str, y: str, bins: int, keys) -> DataFrame:
    """Hexagon cells of points that carry their scope's ranges ``__x0 __x1 __y0 __y1``, counted per ``keys``."""
    wx, wy = _width("__x0", "__x1", bins), _width("__y0", "__y1", bins)
    pts = pts.withColumns({"__wx": wx, "__wy": wy})
    u = (F.col(x) - F.col("__x0")) / F.col("__wx")
    v = (F.col(y) - F.col("__y0")) / (F.lit(SQRT3) * F.col("__wy"))
    pts = pts.withColumns({"__u": u, "__v": v})
    pts = pts.withColumns({
        "__ia": F.floor(F.col("__u") + F.lit(0.5)), "__ja": F.floor(F.col("__v") + F.lit(0.5)),
        "__ib": F.floor("__u"), "__jb": F.floor("__v")})
    da_u, da_v = F.col("__u") - F.col("__ia"), F.col("__v") - F.col("__ja")
    db_u = F.col("__u") - F.col("__ib") - F.lit(0.5)
    db_v = F.col("__v") - F.col("__jb") - F.lit(0.5)
    da = da_u * da_u + F.lit(3.0) * (da_v * da_v)
    db = db_u * db_u + F.lit(3.0) * (db_v * db_v)
    first = da <= db
    pts = pts.withColumns({
        "lattice": F.when(first, F.lit(0)).otherwise(F.lit(1)),
        "i": F.when(first, F.col("__ia")).otherwise(F.col("__ib")),
        "j": F.when(first, F.col("__ja")).otherwise(F.col("__jb")),
    })
    # The range columns depend only on the keys: carried as aggregates, not hashed as grouping keys.
    counts = pts.groupBy(*keys, "lattice", "i", "j").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("__x0", "__wx", "__y0", "__wy")])
    half = F.col("lattice") * F.lit(0.5)
    return counts.select(
        *keys, "lattice", "i", "j",
        (F.col("__x0") + (F.col("i") + half) * F.col("__wx")).alias("cx"),
        (F.col("__y0") + (F.col("j") + half) * (F.lit(SQRT3) * F.col("__wy"))).alias("cy"),
        "n")


def hex_counts_panels(df: DataFrame, channels, labels, x: str = "fsc_small", bins: int = BEAD_HEX_BINS,
                      by=(), free_y: bool = True) -> DataFrame:
    """A5: hexagon cell counts per (scope keys, panel), a panel per channel against ``x``.

    The x range is shared by all panels of a scope; the y range is per panel
    when ``free_y`` (the reference's ``free_y`` facets) and shared otherwise.
    Missing and non-finite values are in no cell, nor are rows without a
    scope key. All ranges come from one grouped pass over the wide rows; a row
    meets its scope's ranges once and becomes a row per panel only to be counted.
    Output: keys, ``panel``, ``lattice``, ``i``, ``j``, cell centre ``cx``/``cy``, ``n``.
    """
    by, channels = list(by), list(channels)
    pts = _where(df, _present(by)).where(is_finite(x)).select(
        *by, F.col(x).alias("__x"), *[F.when(is_finite(c), F.col(c)).alias(f"__y_{k}") for k, c in enumerate(channels)])
    ys = [f"__y_{k}" for k in range(len(channels))]
    pts = pts.where(F.coalesce(*ys).isNotNull())
    aggs = [F.min("__x").alias("__x0"), F.max("__x").alias("__x1")]
    for k, y in enumerate(ys):
        aggs += [F.min(y).alias(f"__lo_{k}"), F.max(y).alias(f"__hi_{k}")]
    ranges = (pts.groupBy(*by) if by else pts).agg(*aggs)
    if not free_y:
        lo, hi = (F.least if len(ys) > 1 else F.coalesce), (F.greatest if len(ys) > 1 else F.coalesce)
        shared = {"__lo": lo(*[f"__lo_{k}" for k in range(len(ys))]), "__hi": hi(*[f"__hi_{k}" for k in range(len(ys))])}
        ranges = ranges.withColumns(shared).withColumns(
            {f"__{end}_{k}": F.col(f"__{end}") for end in ("lo", "hi") for k in range(len(ys))}).drop("__lo", "__hi")
    pts = keyed_join(pts, ranges, by, how="inner")
    rows = ", ".join(f"'{label}', `__y_{k}`, `__lo_{k}`, `__hi_{k}`" for k, label in enumerate(labels))
    long = pts.select(*by, "__x", "__x0", "__x1",
                      F.expr(f"stack({len(channels)}, {rows}) AS (panel, __y, __y0, __y1)")).where(F.col("__y").isNotNull())
    return _count_cells(long, "__x", "__y", bins, [*by, "panel"])


def hex_counts(df: DataFrame, x: str = "fsc_small", y: str = "y_value", bins: int = BEAD_HEX_BINS,
               panel: str | None = "panel", by=(), free_y: bool = True) -> DataFrame:
    """A5 for points that are already one row per panel (see ``hex_counts_panels``)."""
    by = list(by)
    pkeys = by + ([panel] if panel else [])
    ykeys = pkeys if free_y else by
    pts = _where(df, _present(pkeys)).where(is_finite(x) & is_finite(y))
    per_panel = materialize((pts.groupBy(*pkeys) if pkeys else pts).agg(
        F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1")))
    fits = broadcast_fits(per_panel)
    xr = (per_panel.groupBy(*by) if by else per_panel).agg(
        F.min("__x0").alias("__x0"), F.max("__x1").alias("__x1"))
    yr = per_panel.select(*ykeys, "__y0", "__y1") if ykeys == pkeys else \
        (per_panel.groupBy(*ykeys) if ykeys else per_panel).agg(
            F.min("__y0").alias("__y0"), F.max("__y1").alias("__y1"))
    # One range row per (keys, panel): the particles meet a single small table.
    ranges = plan_join(plan_join(per_panel.select(*pkeys), xr, by), yr, ykeys)
    return _count_cells(keyed_join(pts, ranges, pkeys, how="inner", fits=fits), x, y, bins, pkeys)


def pop_level(df: DataFrame, pop: str = "pop", levels=POP_LEVELS) -> DataFrame:
    """Population label on the cytogram scale: absent column -> 'unknown',
    labels outside ``levels`` -> NULL (R factor semantics)."""
    if pop not in df.columns:
        return df.withColumn(pop, F.lit("unknown"))
    return df.withColumn(pop, F.when(F.col(pop).isin(list(levels)), F.col(pop)))


def log_bin_counts_pairs(df: DataFrame, pairs, bins: int = CYTOGRAM_BINS, by=(), pop: str = "pop",
                         levels=POP_LEVELS, labels=None) -> DataFrame:
    """A6 for several channel pairs with ONE pass for all ranges.

    Per pair, rows with both values positive and finite (and a scope key)
    are binned on log10 scales whose ranges are shared by all populations of a scope. The
    ranges of every pair come from one grouped aggregate (materialised once);
    the particles are then stacked per pair (an Expand, no shuffle) and
    counted. Output: keys, ``pair``, pop, ``ix``, ``iy``, ``n``.
    """
    by = list(by)
    labels = list(labels or [f"{y} vs {x}" for x, y in pairs])
    pts = pop_level(_where(df, _present(by)), pop, levels)
    logs = {}
    for k, (x, y) in enumerate(pairs):
        ok = (F.col(x) > 0) & (F.col(y) > 0) & is_finite(x) & is_finite(y)
        logs[f"__lx{k}"] = F.when(ok, F.log10(x))
        logs[f"__ly{k}"] = F.when(ok, F.log10(y))
    pts = pts.select(*by, pop, *[c.alias(n) for n, c in logs.items()])
    aggs = []
    for k in range(len(pairs)):
        aggs += [F.min(f"__lx{k}").alias(f"x0_{k}"), F.max(f"__lx{k}").alias(f"x1_{k}"),
                 F.min(f"__ly{k}").alias(f"y0_{k}"), F.max(f"__ly{k}").alias(f"y1_{k}")]
    ranges = materialize((pts.groupBy(*by) if by else pts).agg(*aggs))
    fits = broadcast_fits(ranges)
    stack_r = ", ".join(f"'{lab}', `x0_{k}`, `x1_{k}`, `y0_{k}`, `y1_{k}`" for k, lab in enumerate(labels))
    ranges_long = ranges.select(*by, F.expr(
        f"stack({len(pairs)}, {stack_r}) AS (pair, __x0, __x1, __y0, __y1)"))
    stack_p = ", ".join(f"'{lab}', `__lx{k}`, `__ly{k}`" for k, lab in enumerate(labels))
    long = pts.select(*by, pop, F.expr(f"stack({len(pairs)}, {stack_p}) AS (pair, __lx, __ly)")) \
        .where(F.col("__lx").isNotNull())
    long = long.join(F.broadcast(ranges_long) if fits else ranges_long, on=[*by, "pair"], how="inner")
    top = F.lit(bins - 1)
    ix = F.least(F.floor((F.col("__lx") - F.col("__x0")) / _width("__x0", "__x1", bins)), top)
    iy = F.least(F.floor((F.col("__ly") - F.col("__y0")) / _width("__y0", "__y1", bins)), top)
    return long.groupBy(*by, "pair", pop, ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("n"))


def log_bin_counts(df: DataFrame, x: str, y: str, bins: int = CYTOGRAM_BINS, by=(),
                   pop: str = "pop", levels=POP_LEVELS) -> DataFrame:
    """Counts of rectangular bins in log10 space per (scope keys, pop).

    Non-positive or missing values are removed (no log). Ranges are shared by
    all populations of a scope. Output: keys, pop, ``ix``, ``iy``, ``n``.
    """
    return log_bin_counts_pairs(df, [(x, y)], bins, by, pop, levels).drop("pair")


def rescale(df: DataFrame, col: str, lo: float = 3.0, hi: float = 18.0, flat: float = 10.0,
            by=(), out: str = "marker_size") -> DataFrame:
    """Linear rescale of ``col`` to ``[lo, hi]`` within each scope; a
    constant column maps to ``flat``. Range = one aggregate joined back."""
    by = list(by)
    r = (df.groupBy(*by) if by else df).agg(F.min(col).alias("__r0"), F.max(col).alias("__r1"))
    d = keyed_join(df, r, by)
    scaled = (F.col(col) - F.col("__r0")) / (F.col("__r1") - F.col("__r0")) * F.lit(hi - lo) + F.lit(lo)
    return d.withColumn(out, F.when(F.col("__r1") == F.col("__r0"), F.lit(flat)).otherwise(scaled)) \
        .drop("__r0", "__r1")
