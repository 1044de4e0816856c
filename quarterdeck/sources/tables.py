"""Reading and writing tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarterdeck.panel import column

BAD_ROW = "_bad_row"


def _body_lines(spark: SparkSession, path, above: int) -> DataFrame:
    """The lines of each text file from the one after the first ``above`` on, as ``value``; empty lines are left out.

    A file's first lines are in the split at its begin, where generated ids ascend by one: the
    smallest one there, one row per file, tells the place of the others.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    firsts = lines.where("_at = 0").groupBy(F.col("_file").alias("_own")).agg(F.min("_id").alias("_first"))
    body = lines.join(firsts, F.col("_file") == F.col("_own"), "left")
    return body.where((F.col("_at") > 0) | (F.col("_id") - F.col("_first") >= above)).where("value <> ''").select("value")


def read_csv_typed(spark: SparkSession, path, schema: StructType, skip: int = 0, misfits: str = "null",
                   rejected: bool = False) -> DataFrame:
    """CSV files read with a declared schema, so no inference pass is made.

    The first line of each file is its header; ``skip`` lines above it are left out by
    their place, whatever they hold. Every other line gives a row. A cell that does not fit its type, or is missing, is
    null; with ``misfits="drop"`` rows with such cells, or with cells too many, are left out, with
    ``"fail"`` they fail the job. ``rejected=True`` returns the lines of those rows, to be counted or inspected.
    """
    if misfits not in ("null", "drop", "fail"):
        raise ValueError(f"misfits must be null, drop or fail, not {misfits}")
    names = schema.fieldNames()
    layout = StructType([StructField(n, StringType()) for n in [*names, BAD_ROW]])
    if skip:
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_ROW}
        lines = _body_lines(spark, path, skip + 1)
        ddl = ", ".join(f"`{n}` STRING" for n in [*names, BAD_ROW])
        text = lines.select(F.from_csv("value", ddl, options).alias("c")).select("c.*")
    else:
        text = (spark.read.schema(layout).option("header", True).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", BAD_ROW).csv(path))
    # the reader marks lines with too few or too many cells; cells are cast here, since the
    # reader would only look at the columns a query asks for
    typed = {f.name: column(f.name).try_cast(f.dataType) for f in schema.fields}
    misfit = reduce(lambda a, b: a | b, [column(n).isNotNull() & typed[n].isNull() for n in names],
                    column(BAD_ROW).isNotNull())
    line = F.coalesce(column(BAD_ROW), F.concat_ws(",", *[F.coalesce(column(n), F.lit("")) for n in names]))
    if rejected:
        return text.where(misfit).select(line.alias(BAD_ROW))
    if misfits == "fail":
        text = text.where(F.when(misfit, F.raise_error(F.concat(F.lit("line does not fit: "), line))).otherwise(F.lit(True)))
    kept = text.where(~misfit) if misfits == "drop" else text
    return kept.select(*[typed[n].alias(n) for n in names])


#: Forms of numbers and dates as text (18 digits fit 64 bits).
WHOLE = r"^[+-]?[0-9]{1,18}$"
DECIMAL = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def infer_types(df: DataFrame, cols: list[str] | None = None, misfits: float = 0.0) -> DataFrame:
    """name, n, n_null, n_whole, n_decimal, n_date, type: what the text columns hold, one row a column.

    All cells are judged, in one pass of an aggregate that combines on the map side; its plan doesn't grow with the
    columns. Empty and blank cells count as null, spaces around a cell don't matter, every whole number is a decimal as
    well. ``type`` is the narrowest of bigint, double and date that all cells but a share of ``misfits`` have the form of,
    and string for others and for columns without a value.
    """
    cols = list(cols or df.columns)
    cells = df.select(F.posexplode(F.array(*[F.trim(column(c).cast("string")) for c in cols])).alias("_at", "_x"))
    x = F.nullif("_x", F.lit(""))
    count = lambda form: F.coalesce(F.count_if(form), F.lit(0))
    found = cells.groupBy("_at").agg(
        F.count(F.lit(1)).alias("n"), count(x.isNull()).alias("n_null"), count(x.rlike(WHOLE)).alias("n_whole"), count(x.rlike(DECIMAL)).alias("n_decimal"),
        count(x.rlike(DAY) & x.try_cast("date").isNotNull()).alias("n_date"))
    held = F.col("n") - F.col("n_null")
    fits = lambda kind: (held > 0) & (held - F.col(kind) <= held * F.lit(float(misfits)))
    kind = F.when(fits("n_whole"), "bigint").when(fits("n_decimal"), "double").when(fits("n_date"), "date").otherwise("string")
    names = F.array(*[F.lit(c) for c in cols])
    return found.select(F.get(names, F.col("_at")).alias("name"), "n", "n_null", "n_whole", "n_decimal", "n_date", kind.alias("type"))


def read_csv_inferred(spark: SparkSession, path, misfits: float = 0.0) -> DataFrame:
    """CSV files whose types are found from all their cells; cells that don't fit their column's type are null.

    Files must share their header. Without rows, all columns are text.
    """
    text = spark.read.option("header", True).csv(path)
    # one row per column: bounded by the width of the file
    types = {r["name"]: r["type"] for r in infer_types(text, misfits=misfits).collect()}
    return text.select(*[column(c) if types.get(c, "string") == "string" else F.trim(column(c)).try_cast(types[c]).alias(c) for c in text.columns])


def read_sheet_set(spark: SparkSession, folder: str, sheets: dict[str, StructType],
                   skip: int = 0, misfits: str = "null") -> dict[str, DataFrame]:
    """One frame per sheet of a workbook exported as ``folder/<sheet>`` CSV files.

    Each frame carries the sheet it came from in the column ``sheet``.
    """
    return {name: read_csv_typed(spark, f"{folder}/{name}", schema, skip, misfits)
            .withColumn("sheet", F.lit(name))
            for name, schema in sheets.items()}


def read_warehouse(spark: SparkSession, table: str, folder: str | None = None,
                   columns: list[str] | None = None) -> DataFrame:
    """A warehouse table: from the catalog, or from ``folder/<table>.parquet``."""
    df = spark.read.parquet(f"{folder}/{table}.parquet") if folder else spark.table(table)
    return df.select(*columns) if columns else df


def write_dataset(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Write a step's result. Partition by year where later steps read by year.

    With partition columns the rows are first grouped by them, so each value is
    written by as many tasks as its size asks for and not by every task.
    """
    writer = df
    if partition_by:
        writer = df.hint("rebalance", *partition_by)
    out = writer.write.format(fmt).mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if fmt == "csv":
        out = out.option("header", True)
    out.save(path)
    return path


def write_bucketed(df: DataFrame, table: str, entity: list[str], order: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in ``buckets`` by entity, sorted by the order columns within one, and read it back.

    Windows, groupings and joins by the entity then need no exchange, whatever reads the table, and with
    ``spark.sql.requireAllClusterKeysForCoPartition`` off joins by entity and period don't either. Each bucket is written
    by one task as one file, so choose as many as the panel's size asks for: an entity of a panel is bounded by the calendar, but
    a key that holds a large share of unbounded rows would make one bucket large. ``path`` places the files outside the warehouse.
    """
    rows = df.repartition(buckets, *[column(e) for e in entity])
    out = rows.write.format("parquet").bucketBy(buckets, *entity).sortBy(*entity, *order)
    if path:
        out = out.option("path", path)
    out.saveAsTable(table)
    return df.sparkSession.table(table)


def drop_suffixed_columns(df: DataFrame, regex: str = r"\.\d+$") -> DataFrame:
    """Drop columns whose name matches, such as repeats of a header: ``a.1``."""
    return df.select(*[column(c) for c in df.columns if not re.search(regex, c)])


def sanitize_columns(df: DataFrame, prefix: str = "", suffix: str = "",
                     keep: str = "") -> DataFrame:
    """Names of letters, digits and underscores, with a prefix and suffix added.

    ``keep`` lists further characters to leave as they are, such as ``.()``.
    Two columns that end up with one name are an error.
    """
    bad = re.compile(f"[^a-zA-Z0-9_{re.escape(keep)}]")
    names = [bad.sub("_", f"{prefix}{c}{suffix}") for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns would share a name: {clashes}")
    return df.toDF(*names)
