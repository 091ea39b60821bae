"""Query name -> (function of the bound views, SQL of the same result)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from hirelake.queries.bindings import Views
from hirelake.queries.oracle import statement

_MODULES = ("scalars", "tables", "aggregates", "stored", "gates", "models")
_queries: dict[str, Callable[[Views], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    """Register the decorated function under its own name, with its oracle SQL."""

    def register(fn: Callable[[Views], DataFrame]):
        key = name or fn.__name__
        if key in _queries:
            raise ValueError(f"query {key} is registered twice")
        _queries[key] = fn
        _oracles[key] = statement(sql)
        return fn

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"hirelake.queries.{module}")


def _bound(fn: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Views(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bound(fn) for name, fn in _queries.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
