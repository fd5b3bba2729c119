"""All registered queries."""

from hearthway.plans import (  # noqa: F401
    queries_aggregates,
    queries_columns,
    queries_destinations,
    queries_joins,
    queries_plans,
    queries_sources,
    queries_statistics,
)
from hearthway.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
