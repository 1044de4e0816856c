"""Long to wide, wide to long, and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.panel import column


def unpivot_years(df: DataFrame, ids: list[str], year_cols: dict[str, int],
                  value: str = "value", year: str = "yr") -> DataFrame:
    """One row per id and year from one column per year."""
    labelled = df.select(*ids, *[column(c).alias(str(y)) for c, y in year_cols.items()])
    return (labelled.unpivot(ids, [str(y) for y in year_cols.values()], year, value)
            .withColumn(year, F.col(year).cast("int")))


def pivot_series(df: DataFrame, index: list[str], key: str, value: str,
                 names: dict[str, str], unlisted: str = "error") -> DataFrame:
    """One column per series from a long table. ``names`` maps key to column.

    A repeated (index, key) is an error, raised while the aggregate runs. So is a series that
    ``names`` doesn't list, unless ``unlisted="drop"`` asks to leave those out.
    """
    listed = F.coalesce(column(key).isin(*names), F.lit(False))
    if unlisted == "error":
        name = F.concat(F.lit(f"{key} holds a series that is not listed: "), F.coalesce(column(key).cast("string"), F.lit("null")))
        df = df.withColumn(key, F.when(listed, column(key)).otherwise(F.raise_error(name)))
    cells = (df.groupBy(*index).pivot(key, list(names))
             .agg(F.count(F.lit(1)).alias("n"), F.first(value).alias("v")))
    only = lambda k: F.when(F.coalesce(F.col(f"`{k}_n`"), F.lit(0)) <= 1, F.col(f"`{k}_v`")) \
        .otherwise(F.raise_error(F.lit(f"several values for one cell of {k}")))
    return cells.select(*index, *[only(k).alias(names[k]) for k in names])


def transpose_series(df: DataFrame, item: str, periods: list[str], names: dict[str, str],
                     period: str = "period", by: list[str] | None = None, unlisted: str = "error") -> DataFrame:
    """Rows of items and columns of periods become rows of periods and columns of items, within each value of ``by``."""
    ids = [*(by or []), item]
    long = df.select(*ids, *periods).unpivot(ids, periods, period, "value")
    return pivot_series(long, [*(by or []), period], item, "value", names, unlisted)


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows, matched by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
