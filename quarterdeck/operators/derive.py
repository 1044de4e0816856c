"""Derived features: logs, interactions, percentages, a dividend estimate."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.numeric import log_of, percent, ratio
from quarterdeck.operators.windows import scaled_difference
from quarterdeck.panel import PanelSpec, column


def log_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Natural logarithms; zero and negative values give null."""
    return df.withColumns({f"{c}_log": log_of(c) for c in cols})


def interaction_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Ratio and product of every unordered pair of columns; x / 0 is null."""
    out = {}
    for a, b in itertools.combinations(cols, 2):
        out[f"{a}_over_{b}"] = ratio(a, b)
        out[f"{a}_times_{b}"] = column(a) * column(b)
    return df.withColumns(out)


def scale_percent(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """``cols[source] = target``: a percentage as a fraction."""
    return df.withColumns({target: percent(source) for source, target in cols.items()})


def dividend_estimate(df: DataFrame, spec: PanelSpec, params: DataFrame, *, risk_free: str,
                      market_return: str, payout: str, roe_growth: str, dividend: str, shares: str,
                      prices: list[str], default_beta: float = 1.2, capm_sign: int = -1) -> DataFrame:
    """Expected dividend and the income it implies.

    ``params`` holds entity, ``beta`` and ``price_col``, the name of the entity's
    price column among ``prices``. An entity without a row there uses
    ``default_beta`` and has no price, hence null results. The risk premium is
    subtracted by default; ``capm_sign=1`` adds it, as the textbook does.
    """
    (entity,) = spec.entity
    out = scaled_difference(df, spec, dividend, 3, 1, "dividend_growth_rate")
    out = out.join(params.select(F.col(entity), "beta", "price_col"), entity, "left")
    beta = F.coalesce("beta", F.lit(default_beta))
    price = F.coalesce(*[F.when(F.col("price_col") == p, column(p)) for p in prices])
    rf, market = column(risk_free), column(market_return)
    out = out.withColumn("required_return", rf + capm_sign * beta * (market - rf))
    out = out.withColumn("growth_of_equity", (1 - percent(payout)) * column(roe_growth))
    out = out.withColumn("D1", price * (F.col("required_return") - F.col("dividend_growth_rate")))
    out = out.withColumn("total_D1", F.col("D1") * column(shares))
    return (out.withColumn("estimated_NI_wD1", ratio("total_D1", percent(payout)))
            .drop("beta", "price_col"))
