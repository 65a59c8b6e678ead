from cytotide.sources.parquet import scan_parquet, bead_sample, grid_bins, read_gridded
from cytotide.sources.tables import sfl_series, stat_series
from cytotide.sources.vct import (read_vct, vct_columns, vct_file_hour, vct_files,
                                  ambiguous_vct_hours, empty_vct)
from cytotide.sources.catalog import (read_registry, normalize_registry, list_files, classify_files,
                                      duplicate_files, assert_unique, build_catalog,
                                      default_variation)
from cytotide.sources.merge import merged_parquet, widened
from cytotide.sources.zones import may_hold, read_window, zone_map, zone_range
from cytotide.sources.sqlite import read_sqlite, read_sfl_with_flags, register_sqlite

__all__ = [n for n in dir() if not n.startswith("_")]
