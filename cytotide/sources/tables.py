"""SFL and Stat tables.

These shape the rows read from a cruise database (``read_sqlite``) or any
frame with the same columns. Nothing is sorted here: ordering is an output
concern (a global sort is a full shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.functions.columns import QUANTILE, REFRAC, require_columns
from cytotide.functions.numeric import nulls_for_nans
from cytotide.functions.time import parse_time
from cytotide.operators.filters import keep_quantile

# Fixed values from the reference: the SFL and Stat column sets.
SFL_COLUMNS = ("date", "lat", "lon", "conductivity", "salinity", "ocean_tmp", "par",
               "stream_pressure", "event_rate", "flag")
STAT_COLUMNS = ("time", "pop", "opp_evt_ratio", "n_count", "abundance", "fsc_med", "chl_med",
                "pe_med")


def sfl_series(df: DataFrame, by=()) -> DataFrame:
    """Ten SFL columns, ``date`` -> ``time``, lat/lon as numbers (bad text
    -> NULL via ``try_cast``). ``time`` is made a UTC timestamp so it can meet
    Stat times (T11)."""
    require_columns(df, SFL_COLUMNS, "SFL table")
    out = df.select(*by, *SFL_COLUMNS).withColumnRenamed("date", "time")
    out = out.withColumns({"lat": F.col("lat").cast("string").try_cast("double"),
                           "lon": F.col("lon").cast("string").try_cast("double")})
    out = parse_time(out, "time", mode="hms")
    return nulls_for_nans(out)


def stat_series(df: DataFrame, quantile: float = QUANTILE, refrac: str = REFRAC,
                by=()) -> DataFrame:
    """Stat rows of one quantile, ten columns, ``diam_{refrac}_med`` ->
    ``diameter``, time parsed (year-month-day hour:minute:second)."""
    diam = f"diam_{refrac}_med"
    require_columns(df, (*STAT_COLUMNS, "quantile", diam, "flag"), "Stat table")
    out = keep_quantile(df, quantile).select(*by, *STAT_COLUMNS, F.col(diam).alias("diameter"), "flag")
    out = parse_time(out, "time", mode="hms")
    return nulls_for_nans(out)
