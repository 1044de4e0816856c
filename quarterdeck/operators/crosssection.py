"""Statistics over all entities of a period, attached to every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.operators.ordered import POSITION, global_position
from quarterdeck.panel import column
from quarterdeck.session import pin

STATISTICS = ("mean", "median", "min", "max", "std", "q1", "q3")
QUARTILES = (0.25, 0.5, 0.75)
# values of one group that a task may hold for the built-in percentile
GROUP_LIMIT = 2_000_000
# size of the quantile sketches of stored states: a few kilobytes a group, a rank error below 1 %
SKETCH = 800


def group_quantiles(df: DataFrame, by: list[str], col: str, probs=QUARTILES,
                    group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per group, column ``quantiles``.

    Groups up to ``group_limit`` values use the built-in percentile, which holds
    the distinct values of a group in one task. The values of larger groups are put in order
    over all tasks, and the two values around each quantile are read off by position:
    one sort and one look-up, whatever the values are. Both take the same values,
    infinities and subnormal numbers included.
    """
    values = df.select(*by, column(col).cast("double").alias("_x")).where(
        reduce(lambda a, b: a & b, [column(k).isNotNull() for k in by], F.col("_x").isNotNull()))
    sizes = pin(values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    hot = sizes.where(F.col("_n") > group_limit)
    wanted = F.array(*[F.lit(p) for p in probs])
    if hot.isEmpty():
        return values.groupBy(*by).agg(F.percentile("_x", wanted).alias("quantiles"))
    values = pin(values, "values")  # it is read for the small groups and for the large ones
    cold = values.join(hot.select(*by), by, "left_anti")
    plain = cold.groupBy(*by).agg(F.percentile("_x", wanted).alias("quantiles"))
    return plain.unionByName(_by_position(values.join(hot.select(*by), by, "left_semi"), hot, by, probs))


def _by_position(values: DataFrame, sizes: DataFrame, by: list[str], probs) -> DataFrame:
    placed = global_position(values, [*by, "_x"])
    starts = placed.groupBy(*by).agg(F.min(POSITION).alias("_start"))
    place = (F.col("_n") - 1) * F.col("_p")
    wanted = sizes.join(starts, by).withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).select(
        *by, "_p", place.alias("_place"), "_start")
    wanted = wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))))
    wanted = pin(wanted.withColumn(POSITION, F.col("_start") + F.col("_rank")), "ranks")
    found = placed.join(wanted, [*by, POSITION]).groupBy(*by, "_p", "_place").agg(
        F.min_by("_x", "_rank").alias("_a"), F.max_by("_x", "_rank").alias("_b"))
    above = F.col("_place") - F.floor("_place")
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - above) * F.col("_a") + above * F.col("_b"))
    return found.groupBy(*by).agg(F.array(*[
        F.max(F.when(F.col("_p") == float(p), value)) for p in probs]).alias("quantiles"))


def _name(col: str, group: str, statistic: str) -> str:
    return f"{col}_{group}_{statistic}"


def _moments(cols: list[str], tag: str) -> list:
    return [f(column(c)).alias(_name(c, tag, s)) for c in cols
            for s, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))]


def _from_quartiles(cols: list[str], tag: str) -> list:
    return [F.get(F.col(f"_q_{c}"), F.lit(i)).alias(_name(c, tag, s))
            for c in cols for i, s in enumerate(("q1", "median", "q3"))]


def _large_group_statistics(df: DataFrame, by: list[str], cols: list[str], group: str,
                            group_limit: int) -> DataFrame:
    keyed = df.where(reduce(lambda a, b: a & b, [column(k).isNotNull() for k in by]))
    moments = keyed.groupBy(*by).agg(*_moments(cols, group))
    # all columns are put in order together, in one sort
    long = keyed.select(*by, *[column(c).cast("double").alias(c) for c in cols]).unpivot(by, cols, "_column", "_value")
    found = group_quantiles(long, [*by, "_column"], "_value", QUARTILES, group_limit)
    wide = found.groupBy(*by).agg(*[
        F.first(F.when(F.col("_column") == c, F.col("quantiles")), ignorenulls=True).alias(f"_q_{c}") for c in cols])
    return moments.join(wide, by, "left").select(
        *by, *[column(m) for m in moments.columns if m not in by], *_from_quartiles(cols, group))


def group_statistics(df: DataFrame, cols: list[str], groups: list[str], period: list[str],
                     group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Mean, median, min, max, std and quartiles per period and group, on every row.

    One set of columns per grouping level, named ``<col>_<group>_<statistic>``.
    Rows whose group is null get null statistics. The statistics are aggregated
    and joined back: they are a small table, and no task holds a whole group.

    The sizes of all groups are counted first. Levels whose groups all hold at
    most ``group_limit`` values, over all columns, share one pass with the built-in
    percentile; a level with a larger group has its quartiles read off by position instead.
    """
    sets = [[*period, g] for g in groups]
    keys = [*period, *groups]
    level = F.grouping_id()
    sizes = df.groupingSets(sets, *keys).agg(level.alias("_level"), F.count(F.lit(1)).alias("_n"))
    # one row per level reaches the driver
    largest = {r["_level"]: r["_n"] for r in
               sizes.groupBy("_level").agg(F.max("_n").alias("_n")).collect()}
    # grouping_id has a bit per key, set where the key is not part of the level
    bits = {g: sum(1 << (len(groups) - 1 - j) for j in range(len(groups)) if groups[j] != g) for g in groups}
    small = [g for g in groups if largest.get(bits[g], 0) * len(cols) <= group_limit]

    tables = {}
    if small:
        probs = F.array(*[F.lit(p) for p in QUARTILES])
        tagged = df.groupingSets([[*period, g] for g in small], *period, *small).agg(
            F.grouping_id().alias("_level"), *_moments(cols, ""),
            *[F.percentile(column(c), probs).alias(f"_q_{c}") for c in cols])
        tagged = pin(tagged.select("_level", *period, *small, *[
            column(_name(c, "", s)) for c in cols for s in ("mean", "min", "max", "std")],
            *_from_quartiles(cols, "")), "statistics")
        for i, g in enumerate(small):
            bit = sum(1 << (len(small) - 1 - j) for j in range(len(small)) if j != i)
            tables[g] = tagged.where((F.col("_level") == bit) & column(g).isNotNull()).select(
                *period, g, *[column(_name(c, "", s)).alias(_name(c, g, s)) for c in cols for s in STATISTICS])
    for g in groups:
        if g not in tables:
            tables[g] = pin(_large_group_statistics(df, [*period, g], cols, g, group_limit), "statistics")
    for g in groups:
        df = df.join(tables[g], [*period, g], "left")
    return df


def statistic_states(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """by, measure, n, mean, m2, low, high, sketch: what ``merge_states`` needs of a part of the rows.

    One row per group and measure, to be stored beside the data; when a quarter arrives only its own states are made.
    ``m2`` is the sum of squares around the mean, ``sketch`` a quantile sketch of bounded size. Null measures don't count.
    """
    long = df.select(*[column(b) for b in by], F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), column(c).cast("double").alias("x")) for c in cols])).alias("_cell")).where("_cell.x IS NOT NULL")
    x = F.col("_cell.x")
    return long.groupBy(*[column(b) for b in by], F.col("_cell.measure").alias("measure")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(F.lit(1))).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.kll_sketch_agg_double(x, F.lit(SKETCH)).alias("sketch"))


def merge_states(states: DataFrame, by: list[str]) -> DataFrame:
    """The states of all rows from those of their parts, which may be any number for a group."""
    group = [column(b) for b in [*by, "measure"]]
    parts = Window.partitionBy(*group)
    mean = F.sum(F.col("n") * F.col("mean")).over(parts) / F.sum("n").over(parts)
    apart = F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0))
    return states.withColumn("_mean", mean).groupBy(*group).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + apart).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def statistics_of(states: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, n and the statistics of ``group_statistics``; quartiles are those of the sketch, whose rank
    is off by less than 1 % of a group's rows, all else is exact."""
    at = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(q) for q in QUARTILES]))
    out = states.withColumn("_q", at)
    return out.select(*[column(b) for b in by], "measure", "n", "mean", "low", "high",
                      F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
                      *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(("q1", "median", "q3"))])


def period_total(df: DataFrame, cols: list[str], period: list[str],
                 suffix: str = "_industry_sum") -> DataFrame:
    """Sum over all entities of the period, on every row; 0 where all are missing."""
    sums = df.groupBy(*period).agg(
        *[F.coalesce(F.sum(column(c)), F.lit(0)).alias(f"{c}{suffix}") for c in cols])
    return df.join(pin(sums, "totals"), period, "left")
