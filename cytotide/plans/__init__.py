from cytotide.plans.flows import (sfl_metrics, stat_metrics, filter_intervals, gating_intervals, filter_param_segments,
                                  params_at_points, attach_params, opp_selection, bead_density, gating_cytograms,
                                  gating_outlines, gating_centroids, active_gating, active_polygons,
                                  gridded_scatter, ridgeline_flow, ridgeline_series, select_pops)

__all__ = [n for n in dir() if not n.startswith("_")]
