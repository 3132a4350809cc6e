"""Registered queries over the synthetic star schema, each with its DuckDB statement."""

import seriesloom.queries.modelling  # noqa: F401  registers its queries
from seriesloom.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
