"""All registered queries."""

from recordloom.plans import (discovery_queries, figure_queries, linkage_queries,  # noqa: F401
                              normalize_queries, source_queries, stats_queries,
                              table_queries, text_queries)
from recordloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
