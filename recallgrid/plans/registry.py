"""All registered queries of the retrieval operators, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("text", "pages", "maintenance", "lanes", "ranking", "memory", "learning", "episodes", "analytics", "streams", "more", "procedures", "inputs", "access", "policies")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` is what DuckDB runs on the same tables."""

    def add(query: Query) -> Query:
        _queries[query.__name__] = query
        if sql:
            _sql[query.__name__] = sql
        return query

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"recallgrid.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
