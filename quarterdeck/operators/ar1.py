"""Walking forward through a panel, filling each gap with a one-step forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.panel import PanelSpec, column

# Pairs needed for a fit, and the largest size of the coefficient.
MIN_PAIRS, MAX_COEFFICIENT = 3, 0.999999
#: A past whose spread is below this share of its level counts as constant.
FLAT = 1e-12


def impute_ar1(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    """Each null becomes a + b * (value before), fitted to all earlier pairs.

    (a, b) is the least-squares line of x[t] on x[t-1] over the entity's rows so
    far, filled ones included. With fewer than three pairs, or a constant past,
    the last value is carried. Leading nulls stay. Nothing later than a row is
    used for it.

    An entity of a panel has one row per period, so its rows fit an array: one fold over it per
    column keeps centred running moments, which hold at any level of the values.
    """
    if not spec.bounded:
        raise ValueError("a forward walk is defined by period: it needs a panel")
    types = dict(df.dtypes)
    layout = df.withColumns({c: column(c).cast("double") for c in cols if types[c] != "double"})
    order = F.struct(*[column(c).alias(f"o{i}") for i, c in enumerate(spec.order)])
    row = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(layout.columns)])
    # ties of the order are settled by the row, so that a repeated run walks the same way
    walked = layout.groupBy(*[column(e).alias(f"_e{i}") for i, e in enumerate(spec.entity)]).agg(
        F.sort_array(F.collect_list(F.struct(order.alias("o"), row.alias("r")))).alias("_rows"))
    places = {c: f"c{i}" for i, c in enumerate(layout.columns)}
    for n, c in enumerate(cols):
        walked = walked.withColumn(f"_w{n}", _walk(F.col("_rows")["r"][places[c]]))
    filled = F.arrays_zip(F.col("_rows")["r"].alias("r"), *[F.col(f"_w{n}") for n in range(len(cols))])
    out = walked.select(F.explode(filled).alias("x"))
    by_name = {c: F.col("x").getField(f"_w{n}") for n, c in enumerate(cols)}
    return out.select(*[by_name.get(c, F.col("x")["r"][places[c]]).alias(c) for c in layout.columns])


def _walk(values: Column) -> Column:
    """The values with their gaps filled, as an array."""
    start = F.expr("named_struct('n', 0L, 'mx', 0D, 'my', 0D, 'xx', 0D, 'xy', 0D, 'last', CAST(NULL AS DOUBLE), "
                   "'out', CAST(array() AS ARRAY<DOUBLE>))")

    def step(s: Column, x: Column) -> Column:
        slope = F.greatest(F.least(F.try_divide(s["xy"], s["xx"]), F.lit(MAX_COEFFICIENT)), F.lit(-MAX_COEFFICIENT))
        usable = (s["n"] >= MIN_PAIRS) & (s["xx"] > s["n"] * F.pow(FLAT * s["mx"], F.lit(2)))
        forecast = F.when(usable, s["my"] + slope * (s["last"] - s["mx"])).otherwise(s["last"])
        v = F.coalesce(F.when(F.isnan(x), F.lit(None)).otherwise(x), forecast)
        pair = s["last"].isNotNull() & v.isNotNull()
        n = s["n"] + 1
        dx, dy = s["last"] - s["mx"], v - s["my"]
        mx, my = s["mx"] + dx / n, s["my"] + dy / n
        keep = lambda new, old: F.when(pair, new).otherwise(s[old]).alias(old)
        return F.struct(keep(n, "n"), keep(mx, "mx"), keep(my, "my"), keep(s["xx"] + dx * (s["last"] - mx), "xx"),
                        keep(s["xy"] + dx * (v - my), "xy"), v.alias("last"), F.concat(s["out"], F.array(v)).alias("out"))

    return F.aggregate(values, start, step, lambda s: s["out"])
