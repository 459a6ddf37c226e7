"""The registry behind ``queries()`` and ``oracle_sql()``."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suite.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, str] = {}


def query(name: str, rows: str, sql: str | None = None):
    """Register ``fn(fx) -> DataFrame`` for the survey rows ``rows``; ``sql`` is its oracle."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        ROWS[name] = rows
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap
