from cytotide.operators.filters import (exclude_flags, keep_pops, keep_quantile, at_time, in_hour,
                                       in_range, plottable, aligned, valid_segments, hour_bounds,
                                       flag_text, DEFAULT_EXCLUDED_FLAGS)
from cytotide.operators.joins import sized_broadcast, broadcast_fits, keyed_join, scalar_join
from cytotide.operators.intervals import (to_intervals, with_params, active_at, active_in_hour,
                                         last_match, conflicting_gates, active_rows)
from cytotide.operators.sweep import active_ids, as_of, gate_conflicts, in_hours
from cytotide.operators.aggregates import (hourly_stat, ridgeline, extent, value_range, time_points,
                                          populations, sfl_only_count, flags_present,
                                          series_arrays, ordered)
from cytotide.operators.density import (hex_counts, hex_counts_panels, log_bin_counts, log_bin_counts_pairs, rescale,
                                        pop_level)
from cytotide.operators.gating import gate_outlines, gate_centroids, polygons_for_pop
from cytotide.operators.grid import decode_bins
from cytotide.operators.guides import guide_lines, guide_vlines, guide_hlines, guide_segments
from cytotide.operators.opp import select_opp, replicate_quantiles, opp_predicate, passed_quantiles, quantile_sets

__all__ = [n for n in dir() if not n.startswith("_")]
