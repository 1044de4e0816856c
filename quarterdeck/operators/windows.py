"""Row-relative features of a panel: leads, lags, averages, differences, growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.functions.numeric import ratio
from quarterdeck.operators.ordered import HOME, POSITION, affine_prefix, over_rows, running, with_blocks
from quarterdeck.panel import PanelSpec, column


def add_lead_targets(df: DataFrame, spec: PanelSpec, cols: list[str], suffix: str = "_lag1",
                     drop_last: bool = True) -> DataFrame:
    """Next period's value of each column, and the entity's last row dropped.

    The last row is found by position: a null target does not drop a row.
    """
    out = over_rows(df, spec, lambda w: {
        **{f"{c}{suffix}": F.lead(column(c), 1).over(w) for c in cols},
        "_more": F.lead(F.lit(1), 1).over(w)}, after=1)
    return (out.where(F.col("_more").isNotNull()) if drop_last else out).drop("_more")


def add_year_ago(df: DataFrame, spec: PanelSpec, cols: list[str], periods: int = 4,
                 suffix: str = "_last_year_same_quarter", calendar: bool = False,
                 year: str = "yr") -> DataFrame:
    """The value four rows back; with ``calendar`` the same quarter of last year,
    which differs where the panel has holes."""
    if not calendar:
        return over_rows(df, spec, lambda w: {
            f"{c}{suffix}": F.lag(column(c), periods).over(w) for c in cols}, before=periods)
    keys = [*spec.entity, *spec.order]
    past = df.select(*[(F.col(k) + 1).alias(k) if k == year else F.col(k) for k in keys],
                     *[column(c).alias(f"{c}{suffix}") for c in cols])
    return df.join(past, keys, "left")


def moving_average(df: DataFrame, spec: PanelSpec, cols: list[str], windows=(3, 6, 12, 24),
                   name: str = "{col}_{n}_month_MA") -> DataFrame:
    """Mean of the last n rows, null until all n of them are present and not null."""
    def build(w):
        out = {}
        for c in cols:
            for n in windows:
                f = w.rowsBetween(-(n - 1), 0)
                out[name.format(col=c, n=n)] = F.when(
                    F.count(column(c)).over(f) == n, F.avg(column(c)).over(f))
        return out
    return over_rows(df, spec, build, before=max(windows) - 1)


def rolling_average(df: DataFrame, spec: PanelSpec, cols: list[str], n: int = 3,
                    min_periods: int = 1) -> DataFrame:
    """Mean of the last n rows, from ``min_periods`` values on."""
    def build(w):
        f = w.rowsBetween(-(n - 1), 0)
        return {f"{c}_rolling_avg_{n}": F.when(F.count(column(c)).over(f) >= min_periods,
                                               F.avg(column(c)).over(f)) for c in cols}
    return over_rows(df, spec, build, before=n - 1)


def first_difference(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    return over_rows(df, spec, lambda w: {
        f"{c}_q2q_diff": column(c) - F.lag(column(c), 1).over(w) for c in cols}, before=1)


def add_lags(df: DataFrame, spec: PanelSpec, cols: list[str], lags=(1, 2, 3, 4, 5, 6, 12, 24),
             name: str = "{col}_lag_{k}_month") -> DataFrame:
    return over_rows(df, spec, lambda w: {
        name.format(col=c, k=k): F.lag(column(c), k).over(w) for c in cols for k in lags},
        before=max(lags))


def period_return(df: DataFrame, spec: PanelSpec, col: str, n: int = 252,
                  name: str | None = None) -> DataFrame:
    """Relative change over n rows, null when the base is zero or absent."""
    def build(w):
        base = F.lag(column(col), n).over(w)
        return {name or f"{col}_return": ratio(column(col) - base, base)}
    return over_rows(df, spec, build, before=n)


def scaled_difference(df: DataFrame, spec: PanelSpec, col: str, num_lag: int = 3,
                      den_lag: int = 1, name: str | None = None) -> DataFrame:
    """(x - x num_lag rows back) / x den_lag rows back."""
    def build(w):
        lag = lambda k: F.lag(column(col), k).over(w)
        return {name or f"{col}_scaled_diff": ratio(column(col) - lag(num_lag), lag(den_lag))}
    return over_rows(df, spec, build, before=max(num_lag, den_lag))


def growth_rate(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    """Percent change against the last known value, and growth since the first one.

    Gaps repeat the last known value. The cumulative product of (1 + change) is
    the known value over the first one; it is null on the first valid row and
    before it, and from the row after a zero base on.
    """
    placed = df if spec.bounded else with_blocks(df, spec)
    parts = {}
    for c in cols:
        x = column(c)
        parts[f"_ff_{c}"] = ("last", x)
        parts[f"_v0_{c}"] = ("first", x)
        parts[f"_z_{c}"] = ("max", (x == 0).cast("int"))
    filled = running(placed, spec, parts)

    def build(w):
        out = {}
        for c in cols:
            ff, zero = F.col(f"_ff_{c}"), F.col(f"_z_{c}")
            base = F.lag(ff, 1).over(w)
            out[f"{c}_q2q_pct_change"] = (ratio(ff, base) - 1) * 100
            clean = F.coalesce(F.lag(zero, 1).over(w), F.lit(0)) == 0
            out[f"{c}_q2q_cumulative_growth"] = F.when(
                base.isNotNull() & clean, ratio(ff, F.col(f"_v0_{c}")))
        return out

    out = over_rows(filled, spec, build, before=1).drop(*parts)
    return out if spec.bounded else out.drop(POSITION, HOME)


def ema(df: DataFrame, spec: PanelSpec, cols: list[str], span: int = 3, fold_rows: int = 1_000) -> DataFrame:
    """Recursive exponential average with alpha = 2 / (span + 1), over the whole history.

    Over a gap the weight of the past keeps decaying and the value is carried. In a
    bounded panel each row folds the observations up to it. In an unbounded frame the
    average is an affine step of the one before, and steps are composed by blocks
    of ``fold_rows`` positions.
    """
    alpha = 2.0 / (span + 1)
    past = lambda gap: F.pow(F.lit(1 - alpha), gap.cast("double"))
    placed = df if spec.bounded else with_blocks(df, spec)
    if spec.bounded:
        placed = placed.withColumn(POSITION, F.row_number().over(spec.window()))
    else:
        rows = placed.count()

    def fold(history):
        # history: structs (x, at), oldest first; the first one seeds the average
        seed = F.struct(history[0]["x"].alias("v"), history[0]["at"].alias("at"))

        def step(acc, cur):
            weight = past(cur["at"] - acc["at"])
            return F.struct(((weight * acc["v"] + alpha * cur["x"]) / (weight + alpha)).alias("v"), cur["at"].alias("at"))
        return F.aggregate(F.slice(history, 2, F.size(history)), seed, step, lambda acc: acc["v"])

    for c in cols:
        x = column(c).cast("double")
        if spec.bounded:
            # only observed rows share a partition, so the frame holds observations alone
            w = (Window.partitionBy(*spec.entity, column(c).isNull()).orderBy(POSITION)
                 .rowsBetween(Window.unboundedPreceding, 0))
            history = F.collect_list(F.struct(x.alias("x"), F.col(POSITION).alias("at"))).over(w)
            placed = placed.withColumn("_h", history).withColumn(
                "_e", F.when(column(c).isNotNull(), fold(F.col("_h"))))
        else:
            seen = placed.where(column(c).isNotNull()).select(
                *spec.entity, F.col(POSITION).alias("_at"), x.alias("_x"))
            # blocks of observations, so that a block border copies observations too
            dense = PanelSpec(spec.entity, ("_at",), False, spec.block_rows)
            steps = over_rows(seen, dense, lambda w: {"_gap": F.col("_at") - F.lag("_at").over(w)}, before=1)
            weight = past(F.col("_gap"))
            steps = steps.select(*spec.entity, F.col("_at").alias(POSITION),
                                 F.when(F.col("_gap").isNull(), 0.0).otherwise(weight / (weight + alpha)).alias("_a"),
                                 F.when(F.col("_gap").isNull(), F.col("_x")).otherwise(alpha * F.col("_x") / (weight + alpha)).alias("_b"))
            values = affine_prefix(steps, list(spec.entity), rows, fold_rows).select(POSITION, F.col("_v").alias("_e"))
            placed = placed.join(values, POSITION, "left")
        placed = running(placed, spec, {f"{c}_ema_{span}": ("last", F.col("_e"))}).drop("_h", "_e")
    return placed.drop(POSITION, HOME)
