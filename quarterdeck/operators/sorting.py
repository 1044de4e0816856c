"""Output order, previews and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarterdeck.panel import column


def sort_rows(df: DataFrame, *order: str) -> DataFrame:
    """Order for output. Operators that need an order state it themselves."""
    return df.orderBy(*order)


def head_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def top_rows(df: DataFrame, by: str, k: int, tiebreak: str) -> DataFrame:
    """The ``k`` largest by one column, ties settled by another."""
    return df.orderBy(column(by).desc_nulls_last(), column(tiebreak)).limit(k)


def top_features(importance: DataFrame, k: int) -> DataFrame:
    return top_rows(importance, "importance", k, "feature")
