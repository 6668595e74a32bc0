"""All queries of the library."""

from . import build_queries, choice_queries, event_queries, extra_queries, market_queries, report_queries, search_queries, venue_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
