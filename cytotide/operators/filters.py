"""Row filters.

Every filter is a plain predicate so Catalyst can push it into the Parquet
scan. Time selections are written as half-open ranges on the raw column
(``date_trunc`` equality would not be pushed down).
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytotide.functions.numeric import is_missing

# Fixed values from the reference: flags excluded by default.
DEFAULT_EXCLUDED_FLAGS = ("1", "2", "3")


def flag_text(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """R's ``as.character(flag)``: integral numbers print without a decimal part."""
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.when(col == F.floor(col), F.floor(col).cast("bigint").cast("string")) \
            .otherwise(col.cast("string"))
    return col.cast("string")


def exclude_flags(df: DataFrame, flags=DEFAULT_EXCLUDED_FLAGS, col: str = "flag") -> DataFrame:
    """Drop rows whose flag (as text) is in ``flags``; NULL flags are kept.

    An empty ``flags`` means no filtering.
    """
    flags = [str(f) for f in (flags or [])]
    if not flags:
        return df
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.NumericType):
        # on the column as it is, so that the predicate reaches the Parquet reader
        numbers = [float(f) for f in flags if re.fullmatch(r"-?\d+(\.\d+)?", f)]
        if isinstance(dtype, T.IntegralType):
            numbers = [int(n) for n in numbers if n == int(n)]
        return df.where(F.col(col).isNull() | ~F.col(col).isin(numbers)) if numbers else df
    return df.where(F.col(col).isNull() | ~flag_text(col, dtype).isin(flags))


def keep_pops(df: DataFrame, pops, col: str = "pop") -> DataFrame:
    """Keep rows whose population is in ``pops``; NULL populations drop."""
    return df.where(F.col(col).isin(list(pops)))


def keep_quantile(df: DataFrame, quantile: float = 50, col: str = "quantile") -> DataFrame:
    """P10: rows of one quantile (compared numerically)."""
    return df.where(F.col(col).cast("double") == F.lit(float(quantile)))


def _to_utc(ts) -> _dt.datetime:
    if isinstance(ts, str):
        ts = _dt.datetime.fromisoformat(ts.replace("Z", "+00:00"))
    if ts.tzinfo is not None:
        ts = ts.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return ts


def _lit_ts(ts: _dt.datetime) -> Column:
    return F.lit(ts.isoformat(sep=" ")).cast(T.TimestampType())


def at_time(df: DataFrame, ts, col: str = "time") -> DataFrame:
    """P5: rows at exactly the selected (3-minute) time point."""
    if ts is None:
        return df.where(F.lit(False))
    return df.where(F.col(col) == _lit_ts(_to_utc(ts)))


def hour_bounds(ts) -> tuple[_dt.datetime, _dt.datetime]:
    """UTC hour ``[start, end)`` holding ``ts`` (driver-side scalar math)."""
    start = _to_utc(ts).replace(minute=0, second=0, microsecond=0)
    return start, start + _dt.timedelta(hours=1)


def in_hour(df: DataFrame, ts, col: str = "time") -> DataFrame:
    """Rows in the UTC hour of ``ts``; no selection gives no rows."""
    if ts is None:
        return df.where(F.lit(False))
    start, end = hour_bounds(ts)
    return in_range(df, start, end, col=col)


def in_range(df: DataFrame, start, end, col: str = "time", pops=None,
             pop_col: str = "pop") -> DataFrame:
    """Half-open window ``start <= col < end``, optionally with a population filter."""
    cond = (F.col(col) >= _lit_ts(_to_utc(start))) & (F.col(col) < _lit_ts(_to_utc(end)))
    out = df.where(cond)
    return keep_pops(out, pops, pop_col) if pops is not None else out


def plottable(df: DataFrame, cols, log_cols=()) -> DataFrame:
    """Every column in ``cols`` present (not NULL/NaN) and each log axis > 0."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~is_missing(c)
    for c in log_cols:
        cond = cond & (F.col(c) > 0)
    return df.where(cond)


def aligned(d1: Column | str = "D1", d2: Column | str = "D2",
            width: Column | str | float = "width") -> Column:
    """D1/D2 alignment predicate ``D2 < D1 + width AND D1 < D2 + width``."""
    c1 = F.col(d1) if isinstance(d1, str) else d1
    c2 = F.col(d2) if isinstance(d2, str) else d2
    w = width if isinstance(width, Column) else (F.col(width) if isinstance(width, str) else F.lit(width))
    return (c2 < c1 + w) & (c1 < c2 + w)


def valid_segments(df: DataFrame, start: str = "start_date", end: str = "end_date",
                   value: str = "y_value") -> DataFrame:
    """Segment rows need a start, an end and a value."""
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & ~is_missing(value))
