"""All queries and twins: importing the modules of queries registers them."""

from lectern.plans import extraction_queries, queries, source_queries, text_queries, upkeep_queries  # noqa: F401
from lectern.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
