"""All queries of the library and their SQL twins."""

from __future__ import annotations

from . import state_queries, upkeep_queries  # noqa: F401  register their queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
