"""Registration of named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditloom.catalog.adapters import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Source:
    """Views and tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, *names: str):
        frames = [view(self.spark, self.sf_dir, n) for n in names]
        return frames[0] if len(frames) == 1 else frames

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(source)`` under ``name``; ``sql`` runs over the named views."""

    def add(fn: Callable[[Source], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = with_views(views, sql) if views else sql.strip()
        return fn

    return add


def half_up(a: str, b: str, k: int) -> str:
    """Checking SQL of a / b rounded half up to k decimals, as an integer."""
    return f"CAST((CAST({a} AS HUGEINT) * {2 * 10**k} + ({b})) // (CAST({b} AS HUGEINT) * 2) AS BIGINT)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
