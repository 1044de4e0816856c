"""The panel contract: who the entity is and what orders its rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PanelSpec:
    """Keys of a panel.

    ``entity`` and ``order`` together identify a row. Where the order columns
    are calendar columns (year and quarter, or a date) an entity has at most one
    row per calendar period, so its window partition is bounded by the calendar
    and does not grow with the data. That is what ``bounded=True`` states.

    For frames without that guarantee (raw events, repeated timestamps, one
    entity holding a large share of all rows) use ``bounded=False``: operators
    then cut each entity into blocks of ``block_rows`` rows and no task ever
    holds a whole entity. ``order`` must then end in a tie-break.
    """

    entity: tuple[str, ...]
    order: tuple[str, ...]
    bounded: bool = True
    block_rows: int = 1_000_000

    @staticmethod
    def of(entity, order, **options) -> "PanelSpec":
        as_tuple = lambda v: (v,) if isinstance(v, str) else tuple(v)
        return PanelSpec(as_tuple(entity), as_tuple(order), **options)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.entity).orderBy(*self.order)

    def whole(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def duplicate_keys(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Panel keys that occur more than once: empty when the contract holds."""
    return df.groupBy(*spec.entity, *spec.order).count().where(F.col("count") > 1)


def ensure_panel(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``df``, failing while it runs where a key of a bounded panel occurs more than once.

    The rows of a key are counted in the partitions that the panel's windows use anyway.
    """
    if not spec.bounded:
        return df
    key = [*spec.entity, *spec.order]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    told = F.concat_ws(", ", *[F.coalesce(column(k).cast("string"), F.lit("null")) for k in key])
    single = F.when(place == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("the panel holds a key twice: "), told)))
    return df.withColumn("_single", single).where("_single").drop("_single")


def column(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns of the schema minus an exclusion list."""
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in set(exclude)]
