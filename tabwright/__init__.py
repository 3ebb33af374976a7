"""tabwright: tabular preparation, profiling and model search on Spark DataFrames."""

from tabwright.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
