"""The list of registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str, recursive: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its DuckDB text."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views, recursive=recursive)
        return fn
    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round derived doubles, so that summing in another order gives equal output."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in cols})
