"""Ready-made plans: one query per operator on the standard tables.

Each query comes with the SQL that must give the same rows, where SQL can
express it.
"""

from tablewright.plans import cleaning, charts, columns, features, filters, modeling, profile, sources  # noqa: F401
from tablewright.plans.registry import flagship, oracle_sql, queries

__all__ = ["flagship", "oracle_sql", "queries"]
