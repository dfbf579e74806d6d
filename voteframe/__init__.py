"""voteframe: analytics over repeated answers to the same questions, on Spark DataFrames."""

from voteframe.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
