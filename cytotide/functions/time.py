"""Time helpers: hour flooring, flexible parsing, ISO text.

All timestamps are UTC instants (``TimestampType``) with the session time
zone pinned to UTC (see ``cytotide.session``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that Spark's own parser takes as it is: year-month-day, a 'T' or a blank, then a time.
# "hms" needs seconds, "hm" has none; fractional seconds (hms only), a trailing 'Z' or +hh:mm / +hhmm offset.
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})?"
HMS_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?" + _OFFSET + r"\s*$"
HM_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}" + _OFFSET + r"\s*$"

# The wider grammar, on lower-cased text: a date (year, month by number or English name, day; two-digit years are
# 1969 to 2068), a time, am or pm, an offset. Parts are set apart by anything but letters and digits, or, where all have
# two digits (four in a year), by nothing.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = "(?:" + "|".join(_MONTHS) + ")[a-z]*"
_SEP = r"[^0-9a-z]+"
_UNIT = r"(?:[^0-9a-z]+|\s*(?:hours|hour|hrs|hr|h|minutes|minute|mins|min|m)\s*)"
_DATE = rf"(?:(\d{{4}})(\d{{2}})(\d{{2}})|(\d{{4}}|\d{{2}}){_SEP}(\d{{1,2}}|{_MONTH}){_SEP}(\d{{1,2}}))"
_GAP = r"(?:[^0-9a-z]*t[^0-9a-z]*|[^0-9a-z]+)"
_END = r"\s*(?:([ap])\.?m\.?)?\s*(?:z|utc|gmt|([+-])([01]\d):?([0-5]\d)?)?\s*$"
_HMS = rf"(?:(\d{{2}})(\d{{2}})(\d{{2}}(?:[.,]\d+)?)|(\d{{1,2}}){_UNIT}(\d{{1,2}}){_UNIT}(\d{{1,2}}(?:[.,]\d+)?)\s*(?:seconds|second|secs|sec|s)?)"
_HM = rf"(?:(\d{{2}})(\d{{2}})()|(\d{{1,2}}){_UNIT}(\d{{1,2}})()\s*(?:minutes|minute|mins|min|m(?!\.))?)"
#: A compact date may be followed by a compact time with nothing between.
_COMPACT_GAP = rf"(?:{_GAP}|(?<=^\s{{0,9}}\d{{8}}))"


def one_hour() -> Column:
    """An INTERVAL of one hour (built lazily: Column construction needs a session)."""
    return F.expr("INTERVAL 1 HOUR")


def floor_hour(c: Column | str) -> Column:
    """start of the UTC hour holding ``c``."""
    return F.date_trunc("hour", F.col(c) if isinstance(c, str) else c)


def hour_end(c: Column | str) -> Column:
    """end (exclusive) of the UTC hour holding ``c``."""
    return floor_hour(c) + one_hour()


def as_utc_timestamp(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Make ``c`` a TIMESTAMP (instant). ``timestamp_ntz`` wall clocks are read as UTC."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast(T.TimestampType())


def _grammar(time: str) -> str:
    return rf"^\s*{_DATE}{_COMPACT_GAP}{time}{_END}"


def _tokens(text: Column, time: str) -> Column:
    """The parts of a date and time by the wider grammar as a timestamp; null where it doesn't fit."""
    low = F.lower(F.trim(text))
    pattern = _grammar(time)
    # of each pair of groups one is empty: year, month, day, hour, minute, second, half of day, sign, offset
    parts = F.split(F.regexp_replace(low, pattern, "$1$4|$2$5|$3$6|$7$10|$8$11|$9$12|$13|$14|$15|$16"), r"\|")

    def number(i: int, kind: str = "int") -> Column:
        return F.coalesce(parts[i].try_cast(kind), F.lit(0).cast(kind))

    year = number(0)
    year = F.when(F.length(parts[0]) == 4, year).when(year < 69, year + 2000).otherwise(year + 1900)
    named = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.substring(parts[1], 1, 3)).cast("int")
    month = F.when(named > 0, named).otherwise(number(1))
    hour, minute, half = number(3), number(4), parts[6]
    second = F.coalesce(F.regexp_replace(parts[5], ",", ".").try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
    midnight = (hour == 24) & (minute == 0) & (second == 0) & (half == "")  # the end of the day
    told = F.when(half == "", F.when(midnight, 0).otherwise(hour)).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    at = F.try_make_timestamp(year, month, number(2), told, minute, second)
    shift = (number(8) * 3600 + number(9) * 60).cast("long") * F.when(parts[7] == "-", -1).otherwise(1)
    at = F.timestamp_micros(F.unix_micros(at) - shift * 1_000_000 + F.when(midnight, 86_400_000_000).otherwise(0))
    return F.when(low.rlike(pattern), at)


def parse_text(col: Column, seconds: bool = True) -> Column:
    """F2 for one text: a timestamp with (``seconds``) or without seconds in it, else null. Text in Spark's own shape
    goes to its parser, which is faster; all else through the wider grammar."""
    txt = F.trim(col)
    pattern, time = (HMS_PATTERN, _HMS) if seconds else (HM_PATTERN, _HM)
    return F.coalesce(F.when(txt.rlike(pattern), F.try_to_timestamp(txt)), _tokens(txt, time))


def parse_time(df: DataFrame, col: str, mode: str = "column", by: list[str] | None = None,
               out: str | None = None) -> DataFrame:
    """flexible timestamp parse of column ``col``.

    * TIMESTAMP input passes through; TIMESTAMP_NTZ is taken as UTC wall time.
    * numeric input is epoch seconds.
    * text is parsed as year, month, day, hour, minute, second; a parse
      without seconds is the fallback. Separators may be any, or none
      between two-digit parts; months may have names, years two digits,
      hours am or pm, times an offset (``parse_text``).

    ``mode='column'`` (reference behaviour for plan start dates) uses the
    fallback only when *no* value of the column (per ``by`` group, if given)
    parses with seconds; ``mode='row'`` falls back per row; ``mode='hms'``
    never falls back (the reference's Stat time parse). The column-level decision is one small
    aggregate joined back on the group key — never a global window.
    """
    out = out or col
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn(out, as_utc_timestamp(F.col(col)))
    if isinstance(dtype, T.NumericType):
        return df.withColumn(out, F.timestamp_seconds(F.col(col).cast("double")))
    text = F.col(col).cast("string")
    hms, hm = parse_text(text), parse_text(text, seconds=False)
    if mode == "hms":
        return df.withColumn(out, hms)
    if mode == "row":
        return df.withColumn(out, F.coalesce(hms, hm))
    if mode != "column":
        raise ValueError(f"mode must be 'column', 'row' or 'hms', not {mode!r}")
    from cytotide.operators.joins import keyed_join  # local: avoids an import cycle
    keys = list(by or [])
    flag = "__any_hms_ok"
    stats = df.groupBy(*keys).agg(F.max(hms.isNotNull()).alias(flag)) if keys else \
        df.agg(F.max(hms.isNotNull()).alias(flag))
    # One row per key (a scalar subquery without keys), measured before any broadcast.
    joined = keyed_join(df, stats, keys)
    return joined.withColumn(out, F.when(F.coalesce(F.col(flag), F.lit(False)), hms).otherwise(hm)) \
        .drop(flag)


def iso_text(c: Column | str) -> Column:
    """``%Y-%m-%dT%H:%M:%SZ`` text in UTC; NULL stays NULL."""
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")
