"""Registry of named queries over the driver tables.

Each entry couples a Spark callable ``(spark, sf_dir) -> DataFrame`` with the
equivalent DuckDB SQL over the same tables (or ``None`` when the result can
only be checked against an invariant or a numpy twin in ``tests/``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def register(name: str, *, ids: tuple[str, ...] | str = (), sql: str | None = None):
    """Decorator registering a query under ``name`` with its oracle SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = Query(name, fn, sql.strip() if sql else None,
                              (ids,) if isinstance(ids, str) else tuple(ids))
        return fn

    return wrap
