"""The registered queries of the engine and, for each that SQL can express, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import modelling, profiling, registry, relational, signals, streams  # noqa: F401  the modules register their queries

flagship = signals.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
