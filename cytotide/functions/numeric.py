"""Numeric Column helpers.

Pure Column expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values from the reference.
# Carbon-to-volume conversion for protist plankton (Menden-Deuer & Lessard 2000):
CARBON_D = 0.261
CARBON_E = 0.860
DIAMETER_DIGITS = 5
# Relative tolerance of R's all.equal():
ALL_EQUAL_TOLERANCE = 1.5e-8
# 16-bit log amplifier: 2^16 levels across 3.5 decades.
LOG_SCALE_LEVELS = 65536.0
LOG_SCALE_DECADES = 3.5

def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN becomes NULL (R treats both as missing)."""
    col = _c(c)
    return F.when(~F.isnan(col), col)


def nulls_for_nans(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Apply ``nan_to_null`` to every float/double column (or to ``cols``)."""
    floats = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))
              and (cols is None or f.name in cols)]
    if not floats:
        return df
    return df.withColumns({c: nan_to_null(c) for c in floats})


def is_missing(c: Column | str) -> Column:
    """R's is.na — NULL or NaN."""
    col = _c(c)
    return col.isNull() | F.isnan(col)


def is_finite(c: Column | str) -> Column:
    """R's is.finite — not NULL, not NaN, not +/-Inf."""
    col = _c(c)
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def equivalent_diameter(qc: Column | str) -> Column:
    """carbon quota (pg C per cell) -> equivalent spherical diameter.

    ``round(2 * (3 / (4 pi) * (Qc / d)^(1/e))^(1/3), 5)``; Qc = 0 gives 0 and a
    negative Qc gives NaN, as in R. Spark rounds HALF_UP.
    """
    volume = F.pow(_c(qc) / F.lit(CARBON_D), F.lit(1.0 / CARBON_E))
    radius = F.pow(F.lit(3.0 / (4.0 * math.pi)) * volume, F.lit(1.0 / 3.0))
    return F.round(F.lit(2.0) * radius, DIAMETER_DIGITS)


def clamp(v: Column | str, lo: Column | str | float, hi: Column | str | float) -> Column:
    """``min(max(v, lo), hi)`` where any missing input gives NULL (R semantics).

    Spark's ``least``/``greatest`` skip NULLs, so the guard is explicit.
    """
    vc = _c(v)
    loc = lo if isinstance(lo, Column) else (F.col(lo) if isinstance(lo, str) else F.lit(lo))
    hic = hi if isinstance(hi, Column) else (F.col(hi) if isinstance(hi, str) else F.lit(hi))
    return F.when(vc.isNotNull() & loc.isNotNull() & hic.isNotNull(),
                  F.least(F.greatest(vc, loc), hic))


def nearly_equal(target: Column | str, current: Column | str,
                 tolerance: float = ALL_EQUAL_TOLERANCE) -> Column:
    """R's ``isTRUE(all.equal(target, current))`` for two scalars.

    Relative difference ``|t - c| / |t|`` when ``|t| > tolerance``, else the
    absolute difference; equal when that is ``<= tolerance``.
    """
    t, c = _c(target), _c(current)
    diff = F.abs(t - c)
    scale = F.abs(t)
    rel = F.when(scale > F.lit(tolerance), diff / scale).otherwise(diff)
    return F.coalesce(rel <= F.lit(tolerance), F.lit(False))


def untransform(df: DataFrame, cols: list[str], scale: float = LOG_SCALE_LEVELS,
                decades: float = LOG_SCALE_DECADES) -> DataFrame:
    """linear channel values -> 16-bit log scale, ``log10(x) / decades * scale``.

    Inferred from the two axis ranges of the reference (linear 1..10^3.5 vs
    0..2^16); both constants are arguments. Non-positive input gives NULL.
    """
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.log10(_c(c)) / F.lit(decades) * F.lit(scale) for c in present})
