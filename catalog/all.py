"""Imports every query module, so that the registry is complete."""

from catalog import report_queries, score_queries, set_queries, source_queries, text_queries, vote_queries  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
