"""Named queries over the test tables, each next to its independent SQL check."""

from surveyloom.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
