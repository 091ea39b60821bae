"""Intermediate results that are written once and read several times."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from hirelake.session import fresh_path
from hirelake.sources.folders import remove

_scope: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def stage(df: DataFrame, label: str, session: SparkSession | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back, in its own session or in `session`.

    This cuts the lineage, outlives lost executors, and leaves later passes a columnar
    table in which they read only the columns they need.
    """
    session = session or df.sparkSession
    path = fresh_path(session, label)
    if _scope.get() is not None:
        _scope.get().append(path)
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged inside, at the end; for work whose results are stored elsewhere by then."""
    scope: list[str] = []
    token = _scope.set(scope)
    try:
        yield
    finally:
        _scope.reset(token)
        for folder in scope:
            remove(spark, folder)


def stage_alone(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Write what `make` returns and remove whatever it staged on the way."""
    path = fresh_path(spark, label)
    with releasing(spark):
        made = make()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)
