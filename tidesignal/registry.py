"""All queries of the library outside the optional subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in _queries:
        raise ValueError(f"query {name} is registered twice")
    _queries[name] = query
    if sql is not None:
        _oracles[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
