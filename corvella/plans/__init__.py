"""All queries of the library, by name."""

from corvella.plans import costing, decisions, io, more, reports, rules, stats, text  # noqa: F401
from corvella.plans.registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL", "query"]
