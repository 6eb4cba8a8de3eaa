"""Query registry: each entry pairs a Spark job with an independent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedlake.sources.domain import Domain, with_ctes

_JOBS: dict[str, Callable[[Domain], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(domain) -> DataFrame`` under ``name`` with its SQL counterpart."""
    def wrap(fn):
        if name in _JOBS:
            raise ValueError(f"duplicate query {name}")
        _JOBS[name] = fn
        if sql is not None:
            _SQL[name] = with_ctes(sql)
        return fn
    return wrap


def _load() -> None:
    import importlib

    for module in ("catalog", "metrics", "ranking", "people", "quality", "vectors", "recommend", "search", "lake", "stream",
                   ):
        importlib.import_module(f"feedlake.plans.{module}_queries")


def jobs() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, folder: fn(Domain(spark, folder))

    return {name: bind(fn) for name, fn in _JOBS.items()}


def sql_texts() -> dict[str, str]:
    _load()
    return dict(_SQL)
