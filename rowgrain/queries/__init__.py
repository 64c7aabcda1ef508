"""Queries on the given tables, one or more per operator, each with its SQL where there is such."""

from rowgrain.queries import checks, keyed, relational, sweeps  # noqa: F401
from rowgrain.queries.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
