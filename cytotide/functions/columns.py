"""Projection and reshape helpers.

Column names of the particle and stat tables are built from two constants,
the quantile and the refraction index variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values from the reference.
QUANTILE = 50
QUANTILES = (2.5, 50, 97.5)
REFRAC = "mid"
# Bead panels: the y channel of each panel (x is always fsc_small), in order,
# and the panel labels.
BEAD_PANEL_CHANNELS = ("chl_small", "pe", "D1", "D2")
BEAD_PANEL_LABELS = ("chl_small vs fsc_small", "pe vs fsc_small",
                     "D1 vs fsc_small", "D2 vs fsc_small")


def quantile_tag(quantile: float = QUANTILE) -> str:
    """``50`` -> ``'50'``, ``2.5`` -> ``'2.5'`` (as used in column names)."""
    q = float(quantile)
    return str(int(q)) if q.is_integer() else str(q)


def require_columns(df: DataFrame, cols, what: str = "input") -> None:
    """Raise ValueError naming the missing columns (replaces the UI's validate())."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Drop every column whose name ends with ``suffix``."""
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def cruise_from_file(path: Column) -> Column:
    """Base name up to its first dot."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(base, r"\..*$", "")


def cruise_from_folder(path: Column) -> Column:
    """Folder base name without an ``_opp`` / ``_vct`` suffix."""
    trimmed = F.regexp_replace(path, "/+$", "")
    base = F.element_at(F.split(trimmed, "/"), -1)
    return F.regexp_replace(base, r"_(opp|vct)$", "")


def cruise_key(path: Column, kind: Column) -> Column:
    """Cruise of a catalog item — folder rule for ``vct_dir`` items, file rule otherwise."""
    return F.when(kind == F.lit("vct_dir"), cruise_from_folder(path)).otherwise(cruise_from_file(path))


def unpivot_panels(df: DataFrame, keys: list[str] | None = None,
                   x: str = "fsc_small", channels=BEAD_PANEL_CHANNELS,
                   labels=BEAD_PANEL_LABELS) -> DataFrame:
    """one row per (particle, panel) with ``y_var``, ``y_value``, ``panel``.

    Rows whose x or y is missing are dropped. Implemented with ``stack`` (an
    Expand node, no shuffle). ``keys`` are carried through.
    """
    keys = [k for k in (keys or []) if k != x]
    pairs = ", ".join(f"'{ch}', '{lab}', `{ch}`" for ch, lab in zip(channels, labels))
    stacked = df.select(*keys, x, F.expr(
        f"stack({len(channels)}, {pairs}) AS (y_var, panel, y_value)"))
    return stacked.where(F.col(x).isNotNull() & ~F.isnan(x)
                         & F.col("y_value").isNotNull() & ~F.isnan("y_value"))
