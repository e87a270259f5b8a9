"""Registry of the retail queries: name -> (query, SQL of the same rows or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketforge.session import computed_once

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, shared: bool = False) -> Callable[[Query], Query]:
    """``shared``: tables that the query's parts have in common are computed once."""

    def put(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = computed_once(query) if shared else query
        if sql:
            SQL[name] = sql
        return query

    return put
