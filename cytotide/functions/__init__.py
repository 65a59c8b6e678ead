from cytotide.functions.time import (floor_hour, hour_end, one_hour, parse_time, iso_text,
                                    as_utc_timestamp)
from cytotide.functions.numeric import (nan_to_null, nulls_for_nans, is_missing, is_finite,
                                       equivalent_diameter, clamp, nearly_equal, untransform)
from cytotide.functions.columns import (quantile_tag, require_columns, drop_suffix,
                                       cruise_from_file, cruise_from_folder, cruise_key,
                                       unpivot_panels)

__all__ = [
    "floor_hour", "hour_end", "one_hour", "parse_time", "iso_text", "as_utc_timestamp",
    "nan_to_null", "nulls_for_nans", "is_missing", "is_finite", "equivalent_diameter",
    "clamp", "nearly_equal", "untransform", "quantile_tag", "require_columns",
    "drop_suffix", "cruise_from_file", "cruise_from_folder", "cruise_key", "unpivot_panels",
]
