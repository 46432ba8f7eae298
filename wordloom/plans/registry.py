"""Collects the queries of the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name`` with its DuckDB twin."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for name in ("aggregates", "indic", "joins", "library", "quality", "search", "sequences", "texts"):
        importlib.import_module(f"wordloom.plans.{name}")


def queries() -> dict[str, Query]:
    """All registered queries."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of the registered queries that have one."""
    _load()
    return dict(_SQL)
