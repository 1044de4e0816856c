"""Equality joins of the panel with statements, dimensions and outside series.

No side is forced to be broadcast. Files and pinned tables carry exact sizes, so
Spark broadcasts what is small and shuffles what is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.operators.skew import SALT, equal_keys, spread
from quarterdeck.panel import column


def _keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str,
                null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, keys, how)
    names = {k: f"_r_{k}" for k in keys}
    return left.join(right.withColumnsRenamed(names), equal_keys(keys, names), how).drop(*names.values())


def join_statements(base: DataFrame, *others: DataFrame, keys: list[str],
                    null_safe: bool = False, heavy: dict[int, float] | None = None) -> DataFrame:
    """``base`` left-joined to each statement table on the identity keys.

    A column present already is not repeated: the first copy wins. All joins use
    the same keys, so each input is shuffled once. ``heavy`` names keys that hold a large share of
    ``base``, as ``skew.heavy_keys`` finds them: they are spread over several partitions
    for the whole chain.
    """
    base, sides, on = spread(base, list(others), list(keys), heavy)

    def add(left, right):
        fresh = [c for c in right.columns if c in on or c not in left.columns]
        return _keyed_join(left, right.select(*[column(c) for c in fresh]), on, "left", null_safe)

    return reduce(add, sides, base).drop(SALT)


def join_dimension(df: DataFrame, dim: DataFrame, key: str, columns: list[str] | None = None,
                   null_safe: bool = False) -> DataFrame:
    """Labels of a company table; a company listed twice repeats the row."""
    side = dim.select(key, *columns) if columns else dim
    return _keyed_join(df, side, [key], "left", null_safe)


def join_on_period(x: DataFrame, y: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Targets joined to features on the panel keys."""
    return _keyed_join(x, y, keys, "left", null_safe)


def outer_join_series(*series: DataFrame, key: str, null_safe: bool = False) -> DataFrame:
    """Every key of any series; absent values are null. With ``null_safe`` null keys equal each other."""
    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        if not null_safe:
            return a.join(b, key, "outer")
        right = b.withColumnRenamed(key, "_key").withColumn("_there", F.lit(True))
        joined = a.join(right, column(key).eqNullSafe(F.col("_key")), "outer")
        return joined.withColumn(key, F.when(F.col("_there"), F.col("_key")).otherwise(column(key))).drop("_key", "_there")

    return reduce(both, series)


def right_join_series(left: DataFrame, right: DataFrame, *more: DataFrame, key: str, null_safe: bool = False) -> DataFrame:
    """Keys of ``right``, with ``left`` and any further series attached."""
    order = [key, *[c for s in (left, right, *more) for c in s.columns if c != key]]
    sides = reduce(lambda a, b: _keyed_join(a, b, [key], "left", null_safe), (left, *more), right)
    return sides.select(*[column(c) for c in order])


def join_month_series(df: DataFrame, month: str, *series: DataFrame, null_safe: bool = False) -> DataFrame:
    """Attach monthly series by calendar month.

    The series hold one row per month, so they are joined with each other first
    and meet the panel in a single join. Where two series share a column name
    the earlier one keeps it.
    """
    taken, parts = {month, *df.columns}, []
    for s in series:
        parts.append(s.select(month, *[column(c) for c in s.columns if c not in taken]))
        taken.update(s.columns)
    months = outer_join_series(*parts, key=month, null_safe=null_safe)
    return _keyed_join(df, months, [month], "left", null_safe)


def join_exact_date(df: DataFrame, other: DataFrame, on: dict[str, str],
                    suffix: str = "_right", null_safe: bool = False) -> DataFrame:
    """Left join on differing key names: ``on[left_key] = right_key``.

    Columns of ``other`` whose name is taken get ``suffix``; its keys are dropped.
    """
    keys = {r: f"_key_{i}" for i, r in enumerate(on.values())}
    rest = {c: f"{c}{suffix}" for c in other.columns if c in df.columns and c not in keys}
    right = other.withColumnsRenamed({**keys, **rest})
    same = equal_keys(list(on), {left: keys[r] for left, r in on.items()}, null_safe)
    return df.join(right, same, "left").drop(*keys.values())
