"""All named queries of the engine and their DuckDB oracles."""

from __future__ import annotations

from . import plans  # noqa: F401  its modules register their queries
from .registry import ORACLES, QUERIES


def queries() -> dict:
    """Name -> function of (spark, folder of tables), in the order of the names."""
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(sorted(ORACLES.items()))
