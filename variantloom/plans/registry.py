"""The queries of the engine by name, and their DuckDB equivalents.

Workers import single query modules, so these take their registry from ``base`` and never from here.
"""

from __future__ import annotations

from . import filter_queries, more_queries, ploidy_queries, stats_queries, table_queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "filter_queries", "more_queries", "ploidy_queries", "stats_queries", "table_queries"]
