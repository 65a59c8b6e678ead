"""Bead-filter guide lines (Q2, J4, with F6 F7).

For each filter parameter row: a vertical line at the bead FSC position in
every panel, horizontal lines at the bead D1 / D2 positions, and the two
filter lines (small / large particles) of the D1 and D2 panels cut into
segments at their intersection and clamped to the panel's x range. All of
it is Column arithmetic on the parameter rows (one row per filter id and
panel), so it runs as one narrow projection — no UDF, no per-group closure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.functions.columns import BEAD_PANEL_LABELS
from cytotide.functions.numeric import clamp, is_finite, nearly_equal
from cytotide.operators.joins import plan_join

# Fixed values from the reference: the fixed axis range of the bead plots.
FIXED_AXIS_LIMITS = (0.0, 65536.0)
_D_PANELS = (("D1", "D1 vs fsc_small"), ("D2", "D2 vs fsc_small"))


def guide_vlines(params: DataFrame, keys=("filter_id",)) -> DataFrame:
    """Vertical guide at ``beads_fsc_small`` in each of the four panels (none if missing)."""
    labels = F.array(*[F.lit(p) for p in BEAD_PANEL_LABELS])
    return params.where(F.col("beads_fsc_small").isNotNull() & ~F.isnan("beads_fsc_small")) \
        .select(*keys, F.explode(labels).alias("panel"),
                F.col("beads_fsc_small").alias("xintercept"))


def guide_hlines(params: DataFrame, keys=("filter_id",)) -> DataFrame:
    """Horizontal guides at ``beads_D1`` / ``beads_D2`` in the D1 / D2 panels; missing dropped."""
    pairs = ", ".join(f"'{label}', `beads_{d}`" for d, label in _D_PANELS)
    out = params.select(*keys, F.expr(f"stack(2, {pairs}) AS (panel, yintercept)"))
    return out.where(F.col("yintercept").isNotNull() & ~F.isnan("yintercept"))


def guide_segments(params: DataFrame, keys=("filter_id",), x_range=FIXED_AXIS_LIMITS,
                   range_keys=()) -> DataFrame:
    """Filter-line segments of the D1 and D2 panels.

    ``x_range`` is a fixed ``(min, max)`` pair (the 0..2^16 axes) or a
    DataFrame with ``range_keys`` + ``x_min``/``x_max`` (the data range, J4).
    A panel keeps its segments only when both lines have finite slope and
    intercept. Nearly equal slopes (R's ``all.equal``) split at ``x_min``,
    so only the large-particle segment survives. Empty segments are dropped.
    """
    keys = list(keys)
    parts = []
    for d, label in _D_PANELS:
        parts.append(f"'{label}', `notch_small_{d}`, `offset_small_{d}`, "
                     f"`notch_large_{d}`, `offset_large_{d}`")
    stacked = params.select(*keys, *[k for k in range_keys if k not in keys], F.expr(
        f"stack(2, {', '.join(parts)}) AS (panel, m_small, b_small, m_large, b_large)"))
    if isinstance(x_range, DataFrame):
        stacked = plan_join(stacked, x_range.select(*range_keys, "x_min", "x_max"), list(range_keys))
        stacked = stacked.where(F.col("x_min").isNotNull() & F.col("x_max").isNotNull())
    else:
        stacked = stacked.withColumns({"x_min": F.lit(float(x_range[0])),
                                       "x_max": F.lit(float(x_range[1]))})
    ok = is_finite("m_small") & is_finite("b_small") & is_finite("m_large") & is_finite("b_large")
    lines = stacked.where(ok)
    x_int = F.when(~nearly_equal("m_small", "m_large"),
                   (F.col("b_large") - F.col("b_small")) / (F.col("m_small") - F.col("m_large")))
    split = F.when(x_int.isNull() | F.isnan(x_int), F.col("x_min")) \
        .otherwise(clamp(x_int, "x_min", "x_max"))
    lines = lines.withColumn("split_x", split)
    seg = F.explode(F.array(
        F.struct(F.lit("small").alias("line_kind"), F.col("m_small").alias("slope"),
                 F.col("b_small").alias("intercept"), F.col("x_min").alias("x_start"),
                 F.col("split_x").alias("x_end")),
        F.struct(F.lit("large").alias("line_kind"), F.col("m_large").alias("slope"),
                 F.col("b_large").alias("intercept"), F.col("split_x").alias("x_start"),
                 F.col("x_max").alias("x_end"))))
    out = lines.select(*keys, *[k for k in range_keys if k not in keys], "panel", seg.alias("s")) \
        .select(*keys, *[k for k in range_keys if k not in keys], "panel", "s.*")
    out = out.where(F.col("x_end") > F.col("x_start"))
    return out.withColumns({
        "y_start": F.col("slope") * F.col("x_start") + F.col("intercept"),
        "y_end": F.col("slope") * F.col("x_end") + F.col("intercept"),
    })


def guide_lines(params: DataFrame, keys=("filter_id",), x_range=FIXED_AXIS_LIMITS,
                range_keys=()) -> dict[str, DataFrame]:
    """Q2: the three guide tables ``{'vline', 'hline', 'segment'}``."""
    return {
        "vline": guide_vlines(params, keys),
        "hline": guide_hlines(params, keys),
        "segment": guide_segments(params, keys, x_range, range_keys),
    }
