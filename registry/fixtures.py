"""Views derived from the given tables, shared by queries, checks and tests.

Each view is one SELECT that means the same in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

#: The years that the tables cover; a year beyond them fails the queries that list them.
YEARS = range(1995, 2002)


def _cell(year: int) -> str:
    count = f"sum(CASE WHEN year(o_orderdate) = {year} THEN 1 ELSE 0 END)"
    if year % 3 == 0:
        return f"concat('1,', CAST(100 + {count} % 900 AS STRING), ' E')"
    if year % 3 == 1:
        return f"CAST({count} AS STRING)"
    return f"CASE WHEN quarter(o_orderdate) = 3 THEN '--' WHEN quarter(o_orderdate) = 4 THEN ' ' ELSE CAST({count} AS STRING) END"


VIEWS = {
    # revisions of a filing line, with ties
    "fx_rev": """
SELECT l_orderkey AS entity, l_linenumber AS period, l_suppkey % 4 AS revision_id,
       CAST(l_shipdate AS DATE) AS period_end, l_quantity AS qty, l_extendedprice AS amount
FROM lineitem""",
    # conflicting filings, with unknown codes and nulls
    "fx_filing": """
SELECT CAST(l_orderkey % 1000 AS INT) AS entity, l_linenumber AS period,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(year(l_shipdate) AS INT) END AS update_key,
       CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS consolidated,
       CASE l_returnflag WHEN 'A' THEN 'MR' WHEN 'N' THEN 'OR' ELSE 'ZZ' END AS filing_status,
       CASE l_suppkey % 3 WHEN 0 THEN 'IAS/IFRS' WHEN 1 THEN 'US GAAP' ELSE 'OTHER' END AS accounting_standard,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(floor(l_quantity / 10) AS DOUBLE) END AS val_a,
       CASE WHEN l_partkey % 7 < 5 THEN NULL ELSE l_quantity END AS val_b
FROM lineitem""",
    # supplier by quarter, with gaps at the head, inside and at the tail
    "fx_quarters": """
SELECT CAST(l_suppkey AS INT) AS entity, CAST(year(l_shipdate) AS INT) AS yr,
       CAST(quarter(l_shipdate) AS INT) AS qtr,
       CAST(max(l_shipdate) AS DATE) AS announce_dt,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sales,
       sum(l_quantity) AS qty
FROM lineitem GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate)""",
    "fx_panel": """
SELECT entity, yr, qtr, seq, announce_dt, sales, qty,
       CASE WHEN entity % 10 = 1 AND seq <= 3 THEN NULL
            WHEN entity % 10 = 2 AND seq > 24 THEN NULL
            WHEN entity % 10 = 3 AND seq <> 5 THEN NULL
            WHEN (entity * 7 + seq) % 6 = 0 THEN NULL
            ELSE sales END AS gappy
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY yr, qtr) AS INT) AS seq
      FROM fx_quarters) AS s""",
    # company -> industry levels
    "fx_company": """
SELECT CAST(s_suppkey AS INT) AS entity, s_nationkey AS group_num,
       CASE WHEN s_nationkey % 9 = 0 THEN NULL ELSE n_name END AS group_label, r_name AS sector_label
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    # daily series
    "fx_market": """
SELECT CAST(o_orderdate AS DATE) AS d,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS idx, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
    # ragged panel
    "fx_user_day": """
SELECT user_id AS entity, CAST(ts AS DATE) AS d,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    # YYYYMM long series with month-13 totals
    "fx_months": """
SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS yyyymm,
       concat('Series ', l_returnflag) AS description, sum(l_quantity) AS val
FROM lineitem GROUP BY year(l_shipdate) * 100 + month(l_shipdate), l_returnflag""",
    "fx_long": """
SELECT * FROM fx_months
UNION ALL
SELECT CAST(floor(yyyymm / 100) * 100 + 13 AS INT), description, sum(val) FROM fx_months
GROUP BY floor(yyyymm / 100), description""",
    # quarter rows, one text column per year: numbers with separators and marks, plain ones, missing ones
    "fx_wide": f"""
SELECT CAST(quarter(o_orderdate) AS INT) AS qtr,
       {", ".join(_cell(y) + f" AS y{y}" for y in YEARS)}
FROM orders GROUP BY quarter(o_orderdate)""",
    # the panel and the daily series in cents: sums of whole numbers are exact in any order
    "fx_cents": """
SELECT entity, yr, qtr, seq, announce_dt, round(sales * 100) AS sales, round(gappy * 100) AS gappy, qty
FROM fx_panel""",
    "fx_index": "SELECT d, round(idx * 100) AS idx, n FROM fx_market",
    # the same series with days on which nothing is traded, which as-of joins look back over
    "fx_trading": "SELECT * FROM fx_market WHERE dayofmonth(d) % 7 <> 0",
    "fx_trading_cents": "SELECT d, round(idx * 100) AS idx, n FROM fx_trading",
    # predictions against truth with null truths
    "fx_pred": """
SELECT entity, yr, qtr, gappy AS truth,
       lag(sales) OVER (PARTITION BY entity ORDER BY seq) AS pred
FROM fx_panel""",
}
NEEDS = {"fx_panel": ["fx_quarters"], "fx_cents": ["fx_quarters", "fx_panel"], "fx_index": ["fx_market"], "fx_trading": ["fx_market"], "fx_trading_cents": ["fx_market", "fx_trading"], "fx_pred": ["fx_quarters", "fx_panel"], "fx_long": ["fx_months"]}


def with_views(select: str, *views: str, recursive: bool = False) -> str:
    """``select`` preceded by the view definitions it needs."""
    names = list(dict.fromkeys(n for v in views for n in [*NEEDS.get(v, []), v]))
    if not names:
        return select
    parts = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = select.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        joint = ",\n"
    else:
        joint = "\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{joint}{body}"


class Tables:
    """The given tables and derived views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            text = with_views(f"SELECT * FROM {name}", name)
            for t in TABLES:
                if any(f" {t}" in VIEWS[v] for v in [*NEEDS.get(name, []), name]):
                    getattr(self, t).createOrReplaceTempView(t)
            return self.spark.sql(text)
        raise AttributeError(name)
