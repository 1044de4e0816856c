"""As-of joins: the latest earlier row of another table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.operators.ordered import running
from quarterdeck.panel import PanelSpec, column
from quarterdeck.session import pin


def _latest_at(times: DataFrame, right: DataFrame, by: list[str], strict: bool,
               block_rows: int) -> DataFrame:
    """For each (by, t) of ``times``, the payload of the latest row of ``right``.

    Both sides hold one row per (by, t). Dates are cut into months, which hold at
    most 31 of them, and the last payload of a month is carried into the next
    ones as one row per month. Finer times have no such bound: there the rows are
    put in order over all tasks and cut into blocks of equal size.
    """
    # a date meets a timestamp as its midnight: the union widens both to the finer type.
    # Rows that must not be seen at an equal time sort behind the ones that look
    right_side, left_side = (1, 0) if strict else (0, 1)
    empty = F.lit(None).cast(right.schema["_p"].dataType)
    seen = right.select(*by, "_t", F.lit(right_side).alias("_side"), "_p")
    asked = times.select(*by, "_t", F.lit(left_side).alias("_side"), empty.alias("_p"))
    both = seen.unionByName(asked)
    if dict(both.dtypes)["_t"] == "date":
        month = F.trunc("_t", "month").alias("_b")
        ends = both.groupBy(*by, month).agg(
            F.max_by("_p", F.when(F.col("_side") == right_side, F.col("_t"))).alias("_end"))
        earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, "_b", F.lit(None).cast("date").alias("_t"), F.lit(-1).alias("_side"),
                              F.last("_end", ignorenulls=True).over(earlier).alias("_p"))
        w = (Window.partitionBy(*by, "_b").orderBy(F.col("_t").asc_nulls_first(), "_side")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = both.select("*", month).unionByName(carried).select(
            *by, "_t", "_side", F.last("_p", ignorenulls=True).over(w).alias("_found"))
    else:
        order = PanelSpec(tuple(by), ("_t", "_side"), bounded=False, block_rows=block_rows)
        found = running(both, order, {"_found": ("last", F.col("_p"))})
    answers = (F.col("_side") == left_side) & F.col("_t").isNotNull()
    return found.where(answers).select(*by, "_t", F.col("_found").alias("_p"))


def _last(tiebreak: str | Sequence[str], payload: Column) -> Column:
    """What the last of several rows at one time is the largest by."""
    names = [tiebreak] if isinstance(tiebreak, str) else tiebreak
    return F.struct(*[column(c).alias(f"_{i}") for i, c in enumerate(names)], payload.alias("_p"))


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, cols: list[str],
              by: dict[str, str] | None = None, strict: bool = True, tiebreak: str | Sequence[str] = (),
              suffix: str = "", block_rows: int = 1_000_000) -> DataFrame:
    """Per left row, ``cols`` of the last right row before its time.

    ``strict`` asks for an earlier time, otherwise an equal one counts. ``by``
    maps left to right columns that must be equal. Of right rows at one time the
    last by ``tiebreak`` is used, and of equal ones the one with the largest ``cols``. A
    null time finds nothing. A date and a timestamp are compared as timestamps.

    The answer depends on (by, time) alone: it is worked out for the distinct
    ones and joined back by equality. Dates make that a small table.
    """
    by = by or {}
    names = [f"_by{i}" for i in range(len(by))]
    times = (left.where(column(left_on).isNotNull())
             .select(*[column(l).alias(n) for l, n in zip(by, names)], column(left_on).alias("_t"))
             .distinct())
    payload = F.struct(*[column(c) for c in cols])
    kept = right.where(column(right_on).isNotNull())
    grouped = kept.groupBy(*[column(r).alias(n) for r, n in zip(by.values(), names)], column(right_on).alias("_t"))
    unique = grouped.agg(F.max_by(payload, _last(tiebreak, payload)).alias("_p"))
    found = pin(_latest_at(times, unique, names, strict, block_rows)
                .select(*names, "_t", *[F.col("_p")[c].alias(f"{c}{suffix}") for c in cols]), "asof")
    same = column(left_on) == F.col("_t")
    for l, n in zip(by, names):
        same = same & (column(l) == F.col(n))
    return left.join(found, same, "left").drop("_t", *names)


def peer_features(df: DataFrame, peers: dict[str, object], entity: str, on: str, cols: list[str],
                  tiebreak: str | Sequence[str] = (), block_rows: int = 1_000_000) -> DataFrame:
    """The latest result every named peer announced strictly before each row.

    Of a peer's results announced at one time the last by ``tiebreak`` counts, and of equal
    ones the one with the largest ``cols``.

    ``peers`` maps a label to the peer's id; columns come out as ``<col>_<label>``.
    The peers are looked up for the distinct times and laid side by side before
    they meet the rows, so the rows themselves are joined once.
    """
    ids = list(peers.values())
    times = (df.where(column(on).isNotNull()).select(column(on).alias("_t")).distinct()
             .withColumn("_by0", F.explode(F.array(*[F.lit(i) for i in ids]))))
    payload = F.struct(*[column(c) for c in cols])
    rows = df.where(column(entity).isin(*ids) & column(on).isNotNull())
    unique = (rows.groupBy(column(entity).alias("_by0"), column(on).alias("_t"))
              .agg(F.max_by(payload, _last(tiebreak, payload)).alias("_p")))
    kind = dict(unique.dtypes)["_by0"]
    times = times.withColumn("_by0", F.col("_by0").cast(kind))
    found = _latest_at(times, unique, ["_by0"], True, block_rows)
    side = found.groupBy("_t").agg(*[
        F.first(F.when(F.col("_by0") == F.lit(i), F.col("_p")[c]), ignorenulls=True).alias(f"{c}_{label}")
        for label, i in peers.items() for c in cols])
    return df.join(pin(side, "peers"), column(on) == F.col("_t"), "left").drop("_t")
