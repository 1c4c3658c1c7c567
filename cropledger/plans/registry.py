"""Importing the query modules registers them."""

from . import clean_queries, feature_queries, market_queries, model_queries, monitor_queries, profile_queries, resolve_queries, source_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
