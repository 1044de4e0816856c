"""Filling the gaps of a panel, and the split into training and test rows.

A panel has one row per entity and calendar period, so the windows here are
bounded by the calendar; an unbounded spec is refused. All windows share one
partitioning and order: one exchange and one sort serve every column. Only
``impute_events`` fills series without that bound, block by block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.operators.ar1 import impute_ar1
from quarterdeck.operators.ordered import POSITION, running, with_blocks
from quarterdeck.panel import PanelSpec, column, ensure_panel
from quarterdeck.session import pin


def _panel(spec: PanelSpec) -> PanelSpec:
    if not spec.bounded:
        raise ValueError("imputation needs a panel: one row per entity and period")
    return spec


def neutralize_sparse_columns(df: DataFrame, spec: PanelSpec, cols: list[str],
                              threshold: float = 0.8) -> DataFrame:
    """A column missing in more than ``threshold`` of an entity's rows becomes 0 there."""
    w = Window.partitionBy(*_panel(spec).entity)
    def fixed(c):
        share = F.avg(column(c).isNull().cast("double")).over(w)
        return F.when(share > threshold, F.lit(0.0)).otherwise(column(c))
    return df.withColumns({c: fixed(c) for c in cols})


def _head(spec: PanelSpec, c: str):
    run = spec.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(column(c), ignorenulls=True).over(spec.whole())
    return F.when(F.count(column(c)).over(run) == 0, first).otherwise(column(c))


def fill_head(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    """Leading nulls take the first known value."""
    return df.withColumns({c: _head(_panel(spec), c) for c in cols})


def _with_row(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumn("_row", F.row_number().over(spec.window()))


def _tail(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    """Trailing nulls follow the line through the last unbroken run of values."""
    w, row = spec.whole(), F.col("_row")
    known = lambda c: column(c).isNotNull()
    df = df.withColumns({f"_l_{c}": F.max(F.when(known(c), row)).over(w) for c in cols})
    # the run starts after the last null before the last value
    df = df.withColumns({f"_b_{c}": F.coalesce(
        F.max(F.when(~known(c) & (row < F.col(f"_l_{c}")), row)).over(w), F.lit(0)) for c in cols})
    z = lambda c: (row - F.col(f"_b_{c}") - 1).cast("double")
    inside = lambda c, v: F.when((row > F.col(f"_b_{c}")) & (row <= F.col(f"_l_{c}")), v)
    sums = {}
    for c in cols:
        x = column(c).cast("double")
        for tag, v in (("m", F.lit(1.0)), ("x", z(c)), ("y", x), ("xy", z(c) * x), ("xx", z(c) * z(c))):
            sums[f"_s{tag}_{c}"] = F.sum(inside(c, v)).over(w)
    df = df.withColumns(sums)

    def value(c):
        m, sx, sy, sxy, sxx = (F.col(f"_s{t}_{c}") for t in ("m", "x", "y", "xy", "xx"))
        slope = F.when(m > 1, F.try_divide(m * sxy - sx * sy, m * sxx - sx * sx)).otherwise(F.lit(0.0))
        level = (sy - slope * sx) / m
        return F.when(row > F.col(f"_l_{c}"), level + slope * z(c)).otherwise(column(c))

    df = df.withColumns({c: value(c) for c in cols})
    return df.drop(*sums, *[f"_{p}_{c}" for c in cols for p in "lb"])


def fill_tail_trend(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    """Trailing nulls extrapolate the least-squares line of the last unbroken run
    of values, by row; a run of one value is carried."""
    return _tail(_with_row(df, _panel(spec)), spec, cols).drop("_row")


def _interior(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    back = spec.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = spec.window().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    row = F.col("_row")

    def value(c):
        seen = F.when(column(c).isNotNull(), F.struct(row.alias("at"), column(c).cast("double").alias("v")))
        a, b = F.last(seen, ignorenulls=True).over(back), F.first(seen, ignorenulls=True).over(ahead)
        slope = (b["v"] - a["v"]) / (b["at"] - a["at"])
        return F.when(column(c).isNull(), a["v"] + slope * (row - a["at"])).otherwise(column(c))

    return df.withColumns({c: value(c) for c in cols})


def fill_interior_linear(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    """Nulls between two known values lie on the line between them, by row."""
    return _interior(_with_row(df, _panel(spec)), spec, cols).drop("_row")


def impute_panel(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    """Head, then tail, then interior. A column without any value stays null."""
    out = _with_row(fill_head(df, spec, cols), spec)
    return _interior(_tail(out, spec, cols), spec, cols).drop("_row")


def impute_wide(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    """``impute_panel`` for hundreds of measures: the same fills, with a plan that doesn't grow with their number.

    Rows are sent to their entity's partition and numbered there. The measures of an entity, which is bounded by the
    calendar, are filled as one matrix of rows and measures. Measures come back as doubles. A key that occurs twice fails the job.
    """
    rows = _with_row(ensure_panel(df.repartition(*[column(e) for e in _panel(spec).entity]), spec), spec)
    others = [c for c in df.columns if c not in cols]
    place = {c: f"c{i}" for i, c in enumerate(others)}
    cells = F.array(*[column(c).cast("double") for c in cols]).cast("array<double>")
    packed = rows.select(*[column(c).alias(a) for c, a in place.items()], "_row", cells.alias("_xs"))
    filled = packed.groupBy(*[place[e] for e in spec.entity]).applyInArrow(_fill_matrix, packed.schema)
    by_name = {c: F.col(a) for c, a in place.items()} | {c: F.get("_xs", F.lit(i)) for i, c in enumerate(cols)}
    return filled.select(*[by_name[c].alias(c) for c in df.columns])


def _fill_matrix(group: pa.Table) -> pa.Table:
    """Head, tail and interior of all measures of one entity; ``known`` tells nulls from values, NaN among them."""
    group = group.combine_chunks().sort_by("_row")
    cells = pa.concat_arrays(group["_xs"].chunks).flatten()
    n, at = len(group), np.arange(len(group))[:, None]
    x = cells.to_numpy(zero_copy_only=False).reshape(n, -1)
    known = cells.is_valid().to_numpy(zero_copy_only=False).reshape(n, -1)
    some, measure = known.any(0), np.arange(x.shape[1])
    last_true = lambda found: np.where(found.any(0), n - 1 - found[::-1].argmax(0), -1)

    first = known.argmax(0)
    x = np.where(at < first, x[first, measure], x)
    known = known | (at < first)

    end = last_true(known)
    gap = last_true(~known & (at < end))
    # the run starts after the last null before the last value
    z, inside = (at - gap - 1).astype("float64"), (at > gap) & (at <= end)
    with np.errstate(all="ignore"):
        m, sx, sy, sxy, sxx = (np.where(inside, v, 0.0).sum(0) for v in (1.0, z, x, z * x, z * z))
        slope = np.where(m > 1, (m * sxy - sx * sy) / (m * sxx - sx * sx), 0.0)
        x = np.where(at > end, (sy - slope * sx) / m + slope * z, x)
        known = known | (at > end)

        back = np.maximum.accumulate(np.where(known, at, 0))
        ahead = np.minimum.accumulate(np.where(known, at, n - 1)[::-1])[::-1]
        a, b = x[back, measure], x[ahead, measure]
        x = np.where(known, x, a + (b - a) / (ahead - back) * (at - back))
    values = pa.array(x.ravel(), mask=np.broadcast_to(~some, x.shape).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), values)
    return group.set_column(group.column_names.index("_xs"), "_xs", lists)


def impute_events(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    """``impute_panel`` for series of any length: the same head, tail and interior, by rows of the entity.

    Rows are worked on in blocks, and a block hands on its last and first known cells, so one entity may hold any
    share of the rows. The line of the tail goes through the last unbroken run of values, head-filled rows included:
    each run is summed up by an ordinary aggregate, and an entity keeps its last one. A series without any value
    stays null.
    """
    if spec.bounded:
        return impute_panel(df, spec, cols)
    entity, at = list(spec.entity), F.col(POSITION)
    known = lambda c: column(c).isNotNull()
    wanted = {"_start": ("first", at)}
    for i, c in enumerate(cols):
        seen = F.when(known(c), F.struct(at.alias("at"), column(c).cast("double").alias("v")))
        wanted |= {f"_a{i}": ("last", seen), f"_b{i}": ("next", seen), f"_g{i}": ("last", F.when(~known(c), at))}
    out = pin(running(pin(with_blocks(df, spec), "placed"), spec, wanted), "runs")
    for i, c in enumerate(cols):
        base = F.coalesce(F.col(f"_g{i}") + 1, F.col("_start"))
        z, x = (at - base).cast("double"), column(c).cast("double")
        runs = out.where(known(c)).groupBy(*entity, base.alias("base")).agg(
            F.min("_start").alias("start"), F.min_by(x, at).alias("first"), F.count(F.lit(1)).cast("double").alias("m"), F.sum(z).alias("x"),
            F.sum(x).alias("y"), F.sum(z * x).alias("xy"), F.sum(z * z).alias("xx"))
        last = F.max_by(F.struct("base", "start", "first", "m", "x", "y", "xy", "xx"), "base")
        lines = pin(_lines(runs.groupBy(*entity).agg(F.min("base").alias("_f"), last.alias("_r")), entity, i), "lines")
        same = reduce(lambda p, q: p & q, [column(e).eqNullSafe(F.col(f"_e{n}")) for n, e in enumerate(entity)], F.lit(True))
        # one row an entity: Spark broadcasts it if it is small, else it splits the entities that hold much
        out = out.join(lines, same, "left").drop(*[f"_e{n}" for n in range(len(entity))])
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        inside = a["v"] + (b["v"] - a["v"]) / F.nullif(b["at"] - a["at"], F.lit(0)) * (at - a["at"])
        out = out.withColumn(c, F.when(known(c), x).when(a.isNull(), b["v"]).when(b.isNotNull(), inside)
                             .otherwise(F.col(f"_level{i}") + F.col(f"_slope{i}") * (at - F.col(f"_from{i}"))))
    return out.select(*[column(c) for c in df.columns])


def _lines(last: DataFrame, entity: list[str], i: int) -> DataFrame:
    """Slope, level and first row of the line through each entity's last run; a run that begins the series takes in the filled head."""
    r = F.col("_r")
    h = F.when(F.col("_f") == r["base"], r["base"] - r["start"]).otherwise(F.lit(0)).cast("double")
    heads, squares = h * (h - 1) / 2, (h - 1) * h * (2 * h - 1) / 6
    m, x, y = r["m"] + h, r["x"] + r["m"] * h + heads, r["y"] + h * r["first"]
    xx = r["xx"] + 2 * h * r["x"] + r["m"] * h * h + squares
    xy = r["xy"] + h * r["y"] + r["first"] * heads
    slope = F.when(m > 1, F.try_divide(m * xy - x * y, m * xx - x * x)).otherwise(F.lit(0.0))
    return last.select(*[column(e).alias(f"_e{n}") for n, e in enumerate(entity)], slope.alias(f"_slope{i}"),
                       ((y - slope * x) / m).alias(f"_level{i}"), (r["base"] - h).alias(f"_from{i}"))


def split_panel(df: DataFrame, spec: PanelSpec, year: str = "yr", cutoff: int = 2018,
                min_train: int = 3) -> DataFrame:
    """Column ``split``: train before ``cutoff``, test from it on. An entity with
    fewer than ``min_train`` training rows is left out of both."""
    w = Window.partitionBy(*_panel(spec).entity)
    early = column(year) < cutoff
    out = df.withColumn("_n", F.count(F.when(early, 1)).over(w))
    return (out.where(F.col("_n") >= min_train).drop("_n")
            .withColumn("split", F.when(early, "train").otherwise("test")))


def build_train_test(df: DataFrame, spec: PanelSpec, features: list[str], targets: list[str],
                     year: str = "yr", cutoff: int = 2018, min_train: int = 3,
                     threshold: float = 0.8) -> dict[str, DataFrame]:
    """The four frames of a forecast: train_x, train_y, test_x and test_y.

    Training rows are neutralised and imputed, targets included. Test features
    are filled forward only, from the imputed training history on; test targets
    stay as they are. A key that occurs twice fails the job. The imputed training rows go
    into three of the frames and are written once.
    """
    keys = [*spec.entity, *spec.order]
    rows = split_panel(ensure_panel(df, spec), spec, year, cutoff, min_train)
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    measures = [*features, *targets]
    train = pin(impute_panel(neutralize_sparse_columns(train, spec, measures, threshold), spec, measures), "imputed")
    x = lambda part: part.drop(*targets)
    history = x(train).unionByName(x(test))
    walked = impute_ar1(history, spec, features).where(F.col("split") == "test")
    y = lambda part: part.select(*keys, *targets)
    return {"train_x": x(train).drop("split"), "train_y": y(train),
            "test_x": walked.drop("split"), "test_y": y(test)}
