"""Row filters, cleaning and column selection."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from quarterdeck.functions.dates import PERIOD_PATTERNS, is_period, period_part
from quarterdeck.functions.numeric import finite
from quarterdeck.panel import column, numeric_columns


def parse_fiscal_period(df: DataFrame, label: str, kind: str, year: str = "yr",
                        quarter: str = "qtr") -> DataFrame:
    """Keep the labels of one kind and add their year and quarter as INT.

    ``kind`` is ``annual`` (``2023 A``), ``quarter`` (``2023 Q1``) or ``estimate``
    (``FQ1 2023 - Mar 2023``). Rows with a null label are dropped, and so are
    estimates without a period in their label.
    """
    rule = PERIOD_PATTERNS[kind]
    text = column(label)
    out = df.where(is_period(text, kind)).withColumn(year, period_part(text, rule["year"]))
    if rule["quarter"]:
        out = out.withColumn(quarter, period_part(text, rule["quarter"]))
    return out.dropna(subset=[year, quarter]) if kind == "estimate" else out


def sentinels_to_null(df: DataFrame, numeric=(0,), text=("NULL", "--", " "),
                      inf: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Replace stand-ins for "missing" by null, frame-wide.

    Numeric stand-ins apply to numeric columns only (text ``'0'`` stays), text
    ones to text columns only. NaN always becomes null, infinities on request.
    """
    def cleaned(field):
        c = column(field.name)
        if columns is not None and field.name not in columns:
            return c
        if isinstance(field.dataType, StringType):
            return F.when(~c.isin(*text), c).alias(field.name) if text else c
        if isinstance(field.dataType, NumericType):
            if isinstance(field.dataType, (DoubleType, FloatType)):
                c = finite(c) if inf else F.nanvl(c, F.lit(None).cast("double"))
            if numeric:
                c = F.when(~c.isin(*numeric), c)
            return c.alias(field.name)
        return c

    return df.select(*[cleaned(f) for f in df.schema.fields])


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    return df.where(column(col).isin(*values))


def filter_between_dates(df: DataFrame, col: str, after, before) -> DataFrame:
    """Rows strictly between two dates. The column is compared as it is stored,
    so the bounds reach the file scan."""
    kind = dict(df.dtypes)[col]
    bound = lambda v: F.lit(v).cast(kind)
    return df.where((column(col) > bound(after)) & (column(col) < bound(before)))


def filter_from(df: DataFrame, col: str, least) -> DataFrame:
    return df.where(column(col) >= F.lit(least))


def drop_annual_totals(df: DataFrame, yyyymm: str) -> DataFrame:
    """Drop month 13, the annual total of a YYYYMM series."""
    return df.where(column(yyyymm) % 100 != 13)


def drop_suffixed_values(df: DataFrame, col: str, suffix: str = ".1") -> DataFrame:
    """Drop rows whose text ends in ``suffix``: repeated headers turned into rows."""
    return df.where(~F.coalesce(column(col).cast("string").endswith(suffix), F.lit(False)))


def drop_max_outlier(df: DataFrame, col: str, also: list[str] | None = None) -> DataFrame:
    """Drop rows where ``col`` (or a column of ``also``) equals the maximum of ``col``.

    Rows with nulls there are kept. The maximum is a scalar subquery of the plan.
    """
    top = df.agg(F.max(column(col)).alias("top")).scalar()
    hits = [F.coalesce(column(c) == top, F.lit(False)) for c in [col, *(also or [])]]
    return df.where(~reduce(lambda a, b: a | b, hits))


def drop_rows_containing(df: DataFrame, source: DataFrame, col: str,
                         columns: list[str] | None = None) -> DataFrame:
    """Drop rows where any numeric cell equals the maximum of ``source[col]``.

    Pass the training frame as ``source`` for training and test rows alike.
    """
    top = source.agg(F.max(column(col)).cast("double").alias("top")).scalar()
    cells = columns or numeric_columns(df)
    hits = [F.coalesce(column(c) == top, F.lit(False)) for c in cells]
    return df.where(~reduce(lambda a, b: a | b, hits))


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(subset=subset)


def flip_sign(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: -column(c) for c in cols})


def map_codes(df: DataFrame, dim: DataFrame, maps: dict[str, tuple[str, str]],
              row_order: str, suffix: str = "_mapped") -> DataFrame:
    """Label code columns: ``maps[code_col] = (dim_code, dim_label)``.

    A code listed twice takes its last label by ``row_order``; an unknown code
    gives null.
    """
    for code_col, (dim_code, dim_label) in maps.items():
        labels = (dim.where(column(dim_code).isNotNull())
                  .groupBy(column(dim_code).alias("_code"))
                  .agg(F.max_by(column(dim_label), column(row_order))
                       .alias(f"{code_col}{suffix}")))
        df = df.join(labels, column(code_col) == F.col("_code"), "left").drop("_code")
    return df


def select_features(df: DataFrame, exclude=(), rename: dict[str, str] | None = None,
                    constants: dict[str, object] | None = None) -> DataFrame:
    """Everything but ``exclude``, with renames and constant label columns."""
    kept = [column(c) for c in df.columns if c not in set(exclude)]
    out = df.select(*kept).withColumnsRenamed(rename or {})
    return out.withColumns({k: F.lit(v) for k, v in (constants or {}).items()})


def cast_numeric(df: DataFrame, columns: list[str] | None = None, to: str = "double") -> DataFrame:
    """Cast measures to one floating type; what does not cast becomes null."""
    cols = columns if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType))]
    return df.withColumns({c: column(c).try_cast(to) for c in cols})


def index_categories(train: DataFrame, cols: list[str], suffix: str = "_index"):
    """Fit category indexes on the training rows only; unseen values share one
    extra index. Returns the fitted model, to transform train and test alike."""
    return StringIndexer(inputCols=cols, outputCols=[f"{c}{suffix}" for c in cols],
                         handleInvalid="keep", stringOrderType="frequencyDesc").fit(train)


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
