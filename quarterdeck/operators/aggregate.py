"""Aggregates over time, groups and forecasts. All combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.dates import to_month
from quarterdeck.panel import column


def monthly_mean(df: DataFrame, date: str, cols: list[str], month: str = "year_month") -> DataFrame:
    """Mean per calendar month; nulls are ignored, undated rows left out."""
    return (df.where(column(date).isNotNull()).groupBy(to_month(date).alias(month))
            .agg(*[F.avg(column(c)).alias(c) for c in cols]))


def global_extrema(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the smallest and largest value of each column."""
    return df.agg(*[f(column(c)).alias(f"{p}_{c}") for c in cols
                    for f, p in ((F.min, "min"), (F.max, "max"))])


def missing_fraction(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of nulls per column, overall or per group."""
    return df.groupBy(*(by or [])).agg(
        *[F.avg(column(c).isNull().cast("double")).alias(f"missing_{c}") for c in cols])


def group_count(df: DataFrame, by: list[str]) -> DataFrame:
    present = df.dropna(subset=by)
    return present.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """Rows scored, RMSE and R2 where truth and prediction are both present.

    One pass: the total sum of squares is n times the population variance.
    R2 of a constant truth is 1 if met exactly, else 0; below two rows it is null.
    """
    t, p = column(y).cast("double"), column(yhat).cast("double")
    sums = (df.where(t.isNotNull() & p.isNotNull()).groupBy(*(by or []))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum((t - p) * (t - p)).alias("sse"),
                 (F.var_pop(t) * F.count(F.lit(1))).alias("sst")))
    r2 = (F.when(F.col("n") < 2, F.lit(None))
          .when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.try_divide(F.col("sse"), F.col("sst"))))
    return sums.select(*(by or []), "n",
                       F.sqrt(F.try_divide(F.col("sse"), F.col("n"))).alias("rmse"),
                       r2.alias("r2"))


def quarterly_r2(df: DataFrame, y: str, yhat: str, year: str = "yr", quarter: str = "qtr") -> DataFrame:
    """R2 of each quarter over the rows of all entities."""
    return regression_metrics(df, y, yhat, [year, quarter]).select(year, quarter, "r2")
