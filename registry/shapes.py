"""Reshaping and equality joins."""

from pyspark.sql import functions as F

from quarterdeck.operators import joins, reshape
from quarterdeck.operators.aggregate import monthly_mean
from quarterdeck.functions.dates import to_month
from registry.book import query
from registry.fixtures import YEARS

SERIES = {"Series A": "series_a", "Series N": "series_n", "Series R": "series_r"}


def years_of(df, date: str) -> list[int]:
    """The years in a table: one row per year."""
    return sorted(r[0] for r in df.select(F.year(date)).distinct().collect())


@query("unpivot_years", " UNION ALL ".join(f"SELECT qtr, {y} AS yr, y{y} AS value FROM fx_wide" for y in YEARS), "fx_wide")
def _(t):
    return reshape.unpivot_years(t.fx_wide, ["qtr"], {f"y{y}": y for y in years_of(t.orders, "o_orderdate")})


@query("pivot_series", """
SELECT yyyymm, max(CASE WHEN description = 'Series A' THEN val END) AS series_a,
       max(CASE WHEN description = 'Series N' THEN val END) AS series_n,
       max(CASE WHEN description = 'Series R' THEN val END) AS series_r
FROM fx_long GROUP BY yyyymm""", "fx_long")
def _(t):
    return reshape.pivot_series(t.fx_long, ["yyyymm"], "description", "val", SERIES)


@query("transpose_series", """
SELECT concat('y', CAST(y AS VARCHAR)) AS period, max(CASE WHEN description = 'Series A' THEN v END) AS series_a,
       max(CASE WHEN description = 'Series N' THEN v END) AS series_n,
       max(CASE WHEN description = 'Series R' THEN v END) AS series_r
FROM (SELECT description, CAST(floor(yyyymm / 100) AS INT) AS y, sum(val) AS v FROM fx_months
      GROUP BY description, floor(yyyymm / 100)) AS s GROUP BY y""", "fx_months")
def _(t):
    years = [f"y{y}" for y in years_of(t.lineitem, "l_shipdate")]
    yearly = t.fx_months.withColumn("y", F.concat(F.lit("y"), F.floor(F.col("yyyymm") / 100)))
    wide = yearly.groupBy("description").pivot("y", years).agg(F.sum("val"))
    return reshape.transpose_series(wide, "description", years, SERIES)


@query("union_rows", """
SELECT entity, yr, qtr, sales, CAST(NULL AS VARCHAR) AS group_label FROM fx_panel UNION ALL
SELECT entity, NULL, NULL, NULL, group_label FROM fx_company""", "fx_panel", "fx_company")
def _(t):
    return reshape.union_rows(t.fx_panel.select("entity", "yr", "qtr", "sales"),
                              t.fx_company.select("entity", "group_label"))


@query("join_statements", """
WITH inc AS (SELECT l_orderkey AS filing, l_linenumber AS period, l_quantity AS revenue, l_tax AS rate
             FROM lineitem WHERE l_linestatus = 'F'),
bal AS (SELECT l_orderkey AS filing, l_linenumber AS period, l_extendedprice AS assets
        FROM lineitem WHERE l_linestatus = 'O'),
cash AS (SELECT l_orderkey AS filing, l_linenumber AS period, count(*) AS cash_rows
         FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber)
SELECT filing, period, revenue, rate, assets, CAST(cash_rows AS BIGINT) AS cash_rows
FROM inc LEFT JOIN bal USING (filing, period) LEFT JOIN cash USING (filing, period)""")
def _(t):
    li = t.lineitem.withColumnsRenamed({"l_orderkey": "filing", "l_linenumber": "period"})
    keys = ["filing", "period"]
    inc = li.where("l_linestatus = 'F'").select(*keys, F.col("l_quantity").alias("revenue"), F.col("l_tax").alias("rate"))
    # the second statement repeats a column of the first: the first copy is kept
    bal = li.where("l_linestatus = 'O'").select(*keys, F.col("l_extendedprice").alias("assets"), F.col("l_tax").alias("rate"))
    cash = li.where("l_returnflag = 'R'").groupBy(*keys).agg(F.count(F.lit(1)).alias("cash_rows"))
    return joins.join_statements(inc, bal, cash, keys=keys)


@query("join_dimension", """
SELECT p.entity, yr, qtr, sales, group_label, sector_label FROM fx_panel p
LEFT JOIN fx_company c ON p.entity = c.entity""", "fx_panel", "fx_company")
def _(t):
    return joins.join_dimension(t.fx_panel.select("entity", "yr", "qtr", "sales"), t.fx_company, "entity",
                                ["group_label", "sector_label"])


@query("join_on_period", """
SELECT x.entity, x.yr, x.qtr, x.sales, y.gappy AS target FROM fx_panel x
LEFT JOIN (SELECT * FROM fx_panel WHERE gappy IS NOT NULL) y ON x.entity = y.entity AND x.yr = y.yr AND x.qtr = y.qtr""",
       "fx_panel")
def _(t):
    p = t.fx_panel
    y = p.where("gappy is not null").select("entity", "yr", "qtr", F.col("gappy").alias("target"))
    return joins.join_on_period(p.select("entity", "yr", "qtr", "sales"), y, ["entity", "yr", "qtr"])


_MONTHLY = """
orders_m AS (SELECT CAST(date_trunc('month', d) AS DATE) AS year_month, avg(idx) AS idx FROM fx_index GROUP BY 1),
ships_m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS year_month, avg(l_quantity) AS ship_qty,
                   avg(l_linenumber) AS idx FROM lineitem GROUP BY 1),
events_m AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS year_month, avg(round(value * 100)) AS event_value
             FROM events GROUP BY 1)"""


def _monthly(t):
    ships = t.lineitem.withColumnRenamed("l_quantity", "ship_qty").withColumnRenamed("l_linenumber", "idx")
    events = t.events.withColumn("event_value", F.round(F.col("value") * 100))
    return (monthly_mean(t.fx_index, "d", ["idx"]), monthly_mean(ships, "l_shipdate", ["ship_qty", "idx"]),
            monthly_mean(events, "ts", ["event_value"]))


@query("join_month_series", f"""
WITH {_MONTHLY}
SELECT entity, yr, qtr, CAST(date_trunc('month', announce_dt) AS DATE) AS year_month, sales,
       orders_m.idx AS idx, ship_qty, event_value
FROM fx_panel LEFT JOIN orders_m ON date_trunc('month', announce_dt) = orders_m.year_month
LEFT JOIN ships_m ON date_trunc('month', announce_dt) = ships_m.year_month
LEFT JOIN events_m ON date_trunc('month', announce_dt) = events_m.year_month""", "fx_index", "fx_panel")
def _(t):
    p = t.fx_panel.select("entity", "yr", "qtr", to_month("announce_dt").alias("year_month"), "sales")
    return joins.join_month_series(p, "year_month", *_monthly(t))


@query("join_exact_date", """
SELECT p.entity, p.yr, p.qtr, p.announce_dt, p.sales, m.n AS n_orders, m.idx AS idx, f.sales AS sales_other
FROM fx_panel p LEFT JOIN fx_market m ON p.announce_dt = m.d
LEFT JOIN (SELECT * FROM fx_panel WHERE qtr <> 3) f
  ON f.yr = p.yr + 1 AND f.qtr = p.qtr AND f.entity = p.entity""", "fx_panel", "fx_market")
def _(t):
    p = t.fx_panel.select("entity", "yr", "qtr", "announce_dt", "sales")
    market = t.fx_market.withColumnRenamed("n", "n_orders")
    out = joins.join_exact_date(p, market, {"announce_dt": "d"}).withColumn("next_yr", F.col("yr") + 1)
    later = t.fx_panel.where("qtr <> 3").select(
        F.col("entity").alias("est_entity"), F.col("yr").alias("est_yr"), F.col("qtr").alias("est_qtr"), "sales")
    return joins.join_exact_date(out, later, {"next_yr": "est_yr", "qtr": "est_qtr", "entity": "est_entity"},
                                 "_other").drop("next_yr")


@query("outer_join_series", f"""
WITH {_MONTHLY}
SELECT year_month, orders_m.idx AS idx, ship_qty, event_value
FROM orders_m FULL JOIN ships_m USING (year_month) FULL JOIN events_m USING (year_month)""", "fx_index")
def _(t):
    a, b, c = _monthly(t)
    return joins.outer_join_series(a, b.drop("idx"), c, key="year_month")


@query("right_join_series", f"""
WITH {_MONTHLY}
SELECT ships_m.year_month, orders_m.idx AS idx, ship_qty, event_value
FROM ships_m LEFT JOIN orders_m ON ships_m.year_month = orders_m.year_month
LEFT JOIN events_m ON ships_m.year_month = events_m.year_month""", "fx_index")
def _(t):
    a, b, c = _monthly(t)
    return joins.right_join_series(a, b.drop("idx"), c, key="year_month")
