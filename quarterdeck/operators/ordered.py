"""Window expressions over a panel, with or without a bound on the entity's size.

A bounded panel uses the plain window of its entity. An unbounded frame is put in
one total order (entity, then order columns) by a range-partitioned sort, which
spreads a large entity over many tasks; every row gets its position there, and
windows run over blocks of positions. A frame that reaches a fixed number of rows
back or ahead sees them because border rows are copied to the neighbouring block;
a running value crosses blocks as one carried row per block.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quarterdeck.panel import PanelSpec, column
from quarterdeck.session import pin

POSITION, BLOCK, HOME = "_position", "_block", "_home"


def global_position(df: DataFrame, order: list[str], name: str = POSITION) -> DataFrame:
    """Add the 0-based position of each row in the total order, as BIGINT.

    Sorted once by range, then written, so that positions are settled before
    they are used; only the row counts of the written parts are summed up. Rows
    with an equal order are told apart by their content and input partition, so
    that many copies of a row do not have to share a task.
    """
    tie = F.xxhash64(F.spark_partition_id(), *[column(c) for c in df.columns])
    spread = df.withColumn("_tie", tie).orderBy(*order, "_tie").drop("_tie")
    # the generated id holds the part in its upper bits and the row in the lower 33
    fixed = pin(spread.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pin(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return (fixed.withColumn("_part", part).join(starts, "_part")
            .withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_id", "_part", "_start"))


def with_blocks(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Position and block of each row of an unbounded frame."""
    placed = global_position(df, [*spec.entity, *spec.order])
    return placed.withColumn(HOME, F.floor(F.col(POSITION) / spec.block_rows))


def _with_borders(blocks: DataFrame, spec: PanelSpec, before: int, after: int) -> DataFrame:
    size = spec.block_rows
    if before > size or after > size:
        raise ValueError(f"a frame of {before} + {after} rows needs block_rows of at least that many")
    at = F.col(POSITION) % size
    targets = [F.col(HOME)]
    if before:
        targets.append(F.when(at >= size - before, F.col(HOME) + 1))
    if after:
        targets.append(F.when(at < after, F.col(HOME) - 1))
    return blocks.withColumn(BLOCK, F.explode(F.array_compact(F.array(*targets))))


def over_rows(df: DataFrame, spec: PanelSpec, build: Callable[[WindowSpec], dict[str, Column]],
              before: int = 0, after: int = 0) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` ahead."""
    if spec.bounded:
        return df.withColumns(build(spec.window()))
    placed = df if POSITION in df.columns else with_blocks(df, spec)
    w = Window.partitionBy(*spec.entity, BLOCK).orderBy(POSITION)
    out = _with_borders(placed, spec, before, after).withColumns(build(w))
    out = out.where(F.col(BLOCK) == F.col(HOME)).drop(BLOCK)
    return out if POSITION in df.columns else out.drop(POSITION, HOME)


# kind -> (value inside the ordered frame, value of a block, join of carried and inside)
_RUNNING = {
    "last": (lambda c: F.last(c, ignorenulls=True),
             lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(POSITION))),
             lambda carried, inside: F.coalesce(inside, carried)),
    "first": (lambda c: F.first(c, ignorenulls=True),
              lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(POSITION))),
              lambda carried, inside: F.coalesce(carried, inside)),
    "max": (F.max, F.max, lambda carried, inside: F.greatest(carried, inside)),
    # looks ahead: the first non-null value from the row on
    "next": (lambda c: F.first(c, ignorenulls=True),
             lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(POSITION))),
             lambda carried, inside: F.coalesce(inside, carried)),
}


def running(df: DataFrame, spec: PanelSpec, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running values from the entity's first row up to each row.

    ``wanted[name] = (kind, column)`` with kind ``last`` or ``first`` (non-null
    value so far), ``max``, or ``next`` (the first non-null value from the row on).
    """
    ends = lambda kind, near: (near, Window.unboundedFollowing) if kind == "next" else (Window.unboundedPreceding, -near)
    if spec.bounded:
        return df.withColumns({n: _RUNNING[k][0](c).over(spec.window().rowsBetween(*ends(k, 0))) for n, (k, c) in wanted.items()})
    placed = df if POSITION in df.columns else with_blocks(df, spec)
    across = lambda kind: Window.partitionBy(*spec.entity).orderBy(HOME).rowsBetween(*ends(kind, 1))
    carried = (placed.groupBy(*spec.entity, HOME)
               .agg(*[_RUNNING[k][1](c).alias(f"_c_{n}") for n, (k, c) in wanted.items()])
               .select(*spec.entity, HOME,
                       *[_RUNNING[k][0](F.col(f"_c_{n}")).over(across(k)).alias(f"_c_{n}")
                         for n, (k, _) in wanted.items()]))
    w = lambda kind: Window.partitionBy(*spec.entity, HOME).orderBy(POSITION).rowsBetween(*ends(kind, 0))
    inside = placed.withColumns({n: _RUNNING[k][0](c).over(w(k)) for n, (k, c) in wanted.items()})
    # an entity without a key is an entity too
    keys = [*spec.entity, HOME]
    carried = carried.select(*[column(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_c_{n}" for n in wanted])
    same = reduce(lambda x, y: x & y, [column(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    out = inside.join(carried, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    out = out.withColumns({n: _RUNNING[k][2](F.col(f"_c_{n}"), F.col(n))
                           for n, (k, _) in wanted.items()}).drop(*[f"_c_{n}" for n in wanted])
    return out if POSITION in df.columns else out.drop(POSITION, HOME)


def affine_prefix(steps: DataFrame, entity: list[str], rows: int, block_rows: int = 1_000) -> DataFrame:
    """``entity``, POSITION and ``_v``: the state after each step v -> a * v + b, from zero on.

    ``steps`` holds ``entity``, POSITION, ``_a`` and ``_b``; ``rows`` is an upper bound on the positions.
    Steps compose, so a block of positions is folded on its own and handed on as one step, and the blocks are
    worked out in the same way, level by level. No task holds more than a block.
    """
    block = F.floor(F.col(POSITION) / block_rows)
    item = F.struct(F.col(POSITION).alias("at"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    start = F.expr("named_struct('a', 1D, 'b', 0D, 'all', CAST(array() AS ARRAY<STRUCT<at: BIGINT, a: DOUBLE, b: DOUBLE>>))")

    def add(done, step):
        a, b = done["a"] * step["a"], step["a"] * done["b"] + step["b"]
        row = F.struct(step["at"].cast("long").alias("at"), a.alias("a"), b.alias("b"))
        return F.struct(a.alias("a"), b.alias("b"), F.concat(done["all"], F.array(row)).alias("all"))

    folded = steps.groupBy(*entity, block.alias("_blk")).agg(
        F.aggregate(F.sort_array(F.collect_list(item)), start, add).alias("_f"))
    inside = folded.select(*entity, "_blk", F.explode("_f.all").alias("_s"))
    if rows <= block_rows:
        return inside.select(*entity, F.col("_s.at").alias(POSITION), F.col("_s.b").alias("_v"))
    ends = folded.select(*entity, F.col("_blk").alias(POSITION), F.col("_f.a").alias("_a"), F.col("_f.b").alias("_b"))
    reached = affine_prefix(ends, entity, -(-rows // block_rows), block_rows)
    # a block starts from where the last one before it that has steps ended
    before = Window.partitionBy(*entity).orderBy(POSITION)
    names = {e: f"_e{i}" for i, e in enumerate(entity)}
    starts = reached.select(*[column(e).alias(n) for e, n in names.items()], F.col(POSITION).alias("_at"),
                            F.lag("_v").over(before).alias("_start"))
    same = reduce(lambda x, y: x & y, [column(e).eqNullSafe(F.col(n)) for e, n in names.items()], F.col("_blk") == F.col("_at"))
    return inside.join(starts, same, "left").select(*entity, F.col("_s.at").alias(POSITION), (
        F.col("_s.a") * F.coalesce("_start", F.lit(0.0)) + F.col("_s.b")).alias("_v"))
