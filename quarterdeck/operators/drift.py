"""Histograms over shared bins, and the population stability index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.panel import column

# Bins by default, and the range shares are clipped to.
BINS, SMALLEST_SHARE, LARGEST_SHARE = 10, 1e-10, 1.0


def _columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[column(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])


def _values(cells: pa.Array) -> np.ndarray:
    return (cells.drop_null() if cells.null_count else cells).to_numpy()


class _Edges:
    """Per column the lowest and highest edge and the bin width, as literals: three numbers a column, read from one row each.

    A single value is widened by 0.5. A column without values has none.
    """

    def __init__(self, df: DataFrame, cols: list[str], bins: int):
        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, tuple[float, float]] = {}
            for batch in batches:
                for at, cells in enumerate(batch.columns):
                    if len(x := _values(cells)):
                        # as in Spark, NaN is above all other values
                        lo, hi = found.get(at, (np.nan, x[0]))
                        found[at] = np.fmin(lo, np.fmin.reduce(x)), np.maximum(hi, x.max())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([v[0] for v in found.values()], pa.float64()),
                                              pa.array([v[1] for v in found.values()], pa.float64())], ["at", "low", "high"])

        low, high = F.min("low"), F.max("high")
        wide = F.when(low == high, 0.5).otherwise(0.0)
        # a task sums up its rows by column, so only one row a task and column is grouped
        parts = _columns(df, cols).mapInArrow(ends, "at int, low double, high double")
        rows = parts.groupBy("at").agg((low - wide).alias("lo"), (high + wide).alias("hi"), ((high + wide - (low - wide)) / bins).alias("step"))
        known = {r["at"]: r for r in rows.collect()}  # one row a column
        self.bins = bins
        self.numbers = {name: [known[i][name] if i in known else None for i in range(len(cols))] for name in ("lo", "hi", "step")}
        self.values = {name: F.array(*[F.lit(v).cast("double") for v in numbers]) for name, numbers in self.numbers.items()}

    def of(self, name: str) -> Column:
        return F.get(self.values[name], F.col("at"))

    def edge(self, i: Column) -> Column:
        return F.when(i == self.bins, F.col("hi")).otherwise(i * F.col("step") + F.col("lo"))

    def with_edges(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: self.of(name) for name in self.values}).where("lo IS NOT NULL")

    def counted(self, df: DataFrame, cols: list[str]) -> DataFrame:
        """at, bin and n: the rows of each column and bin that each task has found."""
        edges, bins = [*zip(*self.numbers.values())], self.bins

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((len(edges), bins), "int64")
            for batch in batches:
                for at, cells in enumerate(batch.columns):
                    if edges[at][0] is not None:
                        n[at] += np.bincount(_bins(_values(cells), *edges[at], bins), minlength=bins)
            at, of = n.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(of, pa.int32()), pa.array(n[at, of])], ["at", "bin", "n"])

        return _columns(df, cols).mapInArrow(count, "at int, bin int, n long")


def _below(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    """a < b as in Spark, where NaN is above all other values."""
    return (a < b) | (np.isnan(b) & ~np.isnan(a))


def _bins(x: np.ndarray, lo: float, hi: float, step: float, bins: int) -> np.ndarray:
    """The bins of the values between the edges."""
    finite, last = np.isfinite([lo, hi, step]).all(), bins - 1
    # with plain edges a NaN is in no bin
    below = np.less if finite else _below
    if step == 0:
        raise ZeroDivisionError("bins without width: the values of a column are too large to widen")
    if finite:
        x = x[(x >= lo) & (x <= hi)]
    else:
        x = x[~_below(x, lo) & ~_below(hi, x)]
    edge = lambda i: np.where(i == bins, hi, i * step + lo)
    with np.errstate(all="ignore"):
        guess = (x - lo) / step
        guess = np.clip(np.floor(guess if finite else np.nan_to_num(guess, nan=0.0)), 0, last)
        # the division may miss by one at an edge: settle it against the edges themselves
        under, over = below(x, edge(guess)), ~below(x, edge(guess + 1)) & (guess < last)
    found = (guess - under + (over & ~under)).astype("int64")
    return found if finite else found[found >= 0]


def _counts(frames: list[DataFrame], edges: _Edges, cols: list[str]) -> DataFrame:
    """Rows of each frame per column and bin as n0, n1 ..., bins without rows included. One pass over each frame."""
    parts = [edges.counted(df, cols).withColumn("tag", F.lit(tag)) for tag, df in enumerate(frames)]
    counted = reduce(DataFrame.unionAll, parts).groupBy("at", "bin").agg(
        *[F.sum(F.when(F.col("tag") == tag, F.col("n"))).alias(f"n{tag}") for tag in range(len(frames))])
    every = frames[0].sparkSession.range(len(cols)).select(
        F.col("id").cast("int").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(edges.bins - 1))).alias("bin"))
    names = F.get(F.array(*[F.lit(c) for c in cols]), F.col("at"))
    return edges.with_edges(every.join(counted, ["at", "bin"], "left")).select(
        names.alias("column"), "bin", edges.edge(F.col("bin")).alias("lower"), edges.edge(F.col("bin") + 1).alias("upper"),
        *[F.coalesce(f"n{tag}", F.lit(0)).alias(f"n{tag}") for tag in range(len(frames))])


def equal_width_histogram(df: DataFrame, cols: list[str], bins: int = BINS,
                          edges_from: DataFrame | None = None) -> DataFrame:
    """Counts over equal bins; the last bin includes its upper edge.

    Edges come from ``edges_from`` (default: the counted frame); values outside
    them are not counted.
    """
    edges = _Edges(edges_from if edges_from is not None else df, cols, bins)
    return _counts([df], edges, cols).withColumnRenamed("n0", "n")


def population_stability_index(expected: DataFrame, actual: DataFrame, cols: list[str],
                               bins: int = BINS) -> DataFrame:
    """PSI of every column, over bins of the expected sample. Both samples are counted in one pass."""
    counts = _counts([expected, actual], _Edges(expected, cols, bins), cols)
    # one row per bin: the totals of a column come from its own few rows
    whole = Window.partitionBy("column")

    def share(n):
        part = F.try_divide(F.col(n).cast("double"), F.sum(n).over(whole).cast("double"))
        clipped = F.least(F.greatest(part, F.lit(SMALLEST_SHARE)), F.lit(LARGEST_SHARE))
        return F.when(part.isNotNull(), clipped)

    both = counts.select("column", share("n0").alias("e"), share("n1").alias("a"))
    return both.groupBy("column").agg(
        F.sum((F.col("e") - F.col("a")) * F.ln(F.col("e") / F.col("a"))).alias("psi"))
