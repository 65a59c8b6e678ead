"""cytotide — flow-cytometry cruise analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames (or Columns) and stays
lazy: nothing here collects data to the driver except bounded size probes
used to decide whether a small side may be broadcast.
"""

from cytotide.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
