"""Numeric expressions with one rule for bad input: the result is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterdeck.panel import column


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(column(a).cast("double"), column(b).cast("double"))


def log_of(c: str | Column) -> Column:
    """Natural logarithm, null for zero and negative input."""
    return F.ln(column(c))


def percent(c: str | Column) -> Column:
    return column(c) / F.lit(100.0)


def finite(c: str | Column) -> Column:
    """Null for NaN and both infinities."""
    x = column(c)
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, x)


def parse_numeric_text(c: str | Column, strip: tuple[str, ...] = (" E", ",")) -> Column:
    """Text such as ``1,234.5 E`` to DOUBLE after removing the given marks."""
    text = column(c).cast("string")
    for mark in strip:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return F.trim(text).try_cast("double")
