"""Sources, sinks and column names."""

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quarterdeck.operators.reshape import union_rows
from quarterdeck.session import scratch_path
from quarterdeck.sources.tables import (DAY, DECIMAL, WHOLE, drop_suffixed_columns, infer_types, read_csv_inferred, read_csv_typed,
                                        read_sheet_set, read_warehouse, sanitize_columns, write_dataset)
from registry.book import query


def _schema(**kinds) -> StructType:
    return StructType([StructField(k, v) for k, v in kinds.items()])


@query("read_csv_typed", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_date
FROM orders""")
def _(t):
    path = scratch_path(t.spark, "orders-csv")
    write_dataset(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                  F.col("o_orderdate").cast("date").alias("o_date")), path, fmt="csv")
    return read_csv_typed(t.spark, path, _schema(
        o_orderkey=LongType(), o_custkey=LongType(), o_orderstatus=StringType(),
        o_totalprice=DoubleType(), o_date=DateType()))


@query("read_sheet_set", """
SELECT 'shipped' AS sheet, CAST(l_shipdate AS DATE) AS d, CAST(count(*) AS INT) AS n FROM lineitem
GROUP BY CAST(l_shipdate AS DATE)
UNION ALL
SELECT 'ordered', CAST(o_orderdate AS DATE), CAST(count(*) AS INT) FROM orders
GROUP BY CAST(o_orderdate AS DATE)""")
def _(t):
    folder = scratch_path(t.spark, "workbook")
    daily = {"shipped": t.lineitem.select(F.col("l_shipdate").cast("date").alias("d")),
             "ordered": t.orders.select(F.col("o_orderdate").cast("date").alias("d"))}
    for sheet, rows in daily.items():
        body = rows.groupBy("d").count().select(F.lit(3).alias("place"), F.concat_ws(",", "d", "count").alias("value"))
        titles = t.spark.createDataFrame([(0, "Back to contents"), (1, "Source,key"), (2, "Date,Rows")], "place int, value string")
        # a sheet is one file, its titles first; it has a row per day
        sheet_rows = titles.unionByName(body).repartition(1).sortWithinPartitions("place")
        sheet_rows.select("value").write.text(f"{folder}/{sheet}")
    sheets = read_sheet_set(t.spark, folder, {s: _schema(d=DateType(), n=IntegerType()) for s in daily}, skip=2)
    return union_rows(*sheets.values()).select("sheet", "d", "n")


def _texts(t):
    """Orders as text, some cells of which are odd."""
    odd = lambda c, n, text: F.when(F.col("o_orderkey") % n == 0, F.lit(text)).otherwise(F.col(c).cast("string"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("key"), odd("o_custkey", 97, "n/a").alias("customer"), odd("o_custkey", 7, " ").alias("gappy"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".50")).alias("price"), day.alias("day"),
        F.when(F.col("o_orderkey") % 89 == 0, "1999-02-31").otherwise(day).alias("odd_day"), F.col("o_orderstatus").alias("status"),
        F.lit(None).cast("string").alias("nothing"))


_TEXTS = """
texts AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS customer,
  CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS gappy, CAST(o_custkey AS VARCHAR) || '.50' AS price,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
  CASE WHEN o_orderkey % 89 = 0 THEN '1999-02-31' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS odd_day,
  o_orderstatus AS status, CAST(NULL AS VARCHAR) AS nothing FROM orders)"""
_TEXT_COLUMNS = ["key", "customer", "gappy", "price", "day", "odd_day", "status", "nothing"]


@query("infer_types", f"""
WITH {_TEXTS},
cells AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, nullif(trim({c}), '') AS x FROM texts" for c in _TEXT_COLUMNS)}),
found AS (SELECT name, count(*) AS n, count(*) - count(x) AS n_null, count(*) FILTER (regexp_matches(x, '{WHOLE}')) AS n_whole,
  count(*) FILTER (regexp_matches(x, '{DECIMAL}')) AS n_decimal,
  count(*) FILTER (regexp_matches(x, '{DAY}') AND TRY_CAST(x AS DATE) IS NOT NULL) AS n_date FROM cells GROUP BY name)
SELECT *, CASE WHEN n = n_null THEN 'string' WHEN n_whole >= 0.98 * (n - n_null) THEN 'bigint' WHEN n_decimal >= 0.98 * (n - n_null) THEN 'double'
  WHEN n_date >= 0.98 * (n - n_null) THEN 'date' ELSE 'string' END AS type FROM found""")
def _(t):
    return infer_types(_texts(t), misfits=0.02)


@query("read_csv_inferred", f"""
WITH {_TEXTS}
SELECT CAST(key AS BIGINT) AS key, CASE WHEN customer <> 'n/a' THEN CAST(customer AS BIGINT) END AS customer,
  CASE WHEN gappy <> ' ' THEN CAST(gappy AS BIGINT) END AS gappy, CAST(price AS DOUBLE) AS price, CAST(day AS DATE) AS day,
  TRY_CAST(odd_day AS DATE) AS odd_day, status, nothing FROM texts""")
def _(t):
    path = scratch_path(t.spark, "texts-csv")
    write_dataset(_texts(t), path, fmt="csv")
    return read_csv_inferred(t.spark, path, misfits=0.02)


@query("read_warehouse", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem""")
def _(t):
    return read_warehouse(t.spark, "lineitem", t.sf_dir, ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"])


@query("write_dataset", "SELECT entity, yr, qtr, seq, announce_dt, sales, gappy FROM fx_panel", "fx_panel")
def _(t):
    path = write_dataset(t.fx_panel.drop("qty"), scratch_path(t.spark, "panel"), ["yr"])
    return t.spark.read.parquet(path).select("entity", "yr", "qtr", "seq", "announce_dt", "sales", "gappy")


@query("drop_suffixed_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(t):
    repeated = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity",
                                 F.col("l_quantity").alias("l_quantity.1"), F.col("l_tax").alias("l_tax.12"))
    return drop_suffixed_columns(repeated)


@query("sanitize_columns", """
SELECT o_orderkey AS est_Order_Key_x, o_totalprice AS est_Total_Price___M__x, o_orderstatus AS est_S_P_status_x
FROM orders""")
def _(t):
    odd = t.orders.select(F.col("o_orderkey").alias("Order Key"), F.col("o_totalprice").alias("Total Price ($M)"),
                          F.col("o_orderstatus").alias("S&P status"))
    return sanitize_columns(odd, "est_", "_x")
