"""All queries of patch linkage by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tidied
from ..streaming import queries as streaming
from . import ranking_queries, scalar_queries

_PARTS = (scalar_queries, ranking_queries, streaming)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query deletes what its operators have kept, but for its result."""
    return {k: tidied(f) for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for part in _PARTS for k, sql in part.ORACLES.items()}
