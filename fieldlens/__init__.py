"""fieldlens: field-sales analytics written as Spark DataFrame plans.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver except one-row scalars where the caller asks for them.
"""

from fieldlens.session import Viewer, build_session, checkpoint_dir

__all__ = ["Viewer", "build_session", "checkpoint_dir"]
