"""The composed jobs, bound to the given tables."""

from pyspark.sql import functions as F

from quarterdeck.functions.dates import to_month
from quarterdeck.operators.reshape import union_rows
from quarterdeck.operators.windows import add_lead_targets
from quarterdeck.panel import PanelSpec
from quarterdeck.plans import feeders, forecasting, panels
from quarterdeck.session import pin
from registry.book import query, rounded
from registry.fills import frames_sql
from registry.shapes import years_of
from registry.panels import _ma_sql, _stats_sql, resolve_sql

PANEL = PanelSpec.of("entity", ("yr", "qtr"))
_LAGS = (1, 2, 3, 4, 5, 6, 12, 24)


def _features_sql(src: str, cols, order: str, lags=(), windows=(3, 6, 12, 24), name="{c}_{n}_month_MA",
                  digits: dict | None = None) -> str:
    """``src`` with moving averages and lags of each column over its one order.

    ``digits`` rounds the averages of columns that are not whole numbers.
    """
    out = [c for c in cols]
    for c in cols:
        for n in windows:
            alias = '"' + name.format(c=c, n=n) + '"'
            text = _ma_sql(c, n, alias)
            if digits:
                text = f"round({text.removesuffix(f' AS {alias}')}, {digits[c]}) AS {alias}"
            out.append(text)
        out += [f"lag({c}, {k}) OVER w AS {c}_lag_{k}_month" for k in lags]
    return f"SELECT {order}, {', '.join(out)} FROM {src} WINDOW w AS (ORDER BY {order})"


_MACRO_DIGITS = {"Spot_Price": 3, "Order_Count": 6, "Shipped": 6}


def _round_averages(df, digits):
    for c, d in digits.items():
        df = rounded(df, *[n for n in df.columns if n.startswith(f"{c}_") and n.endswith("_MA")], digits=d)
    return df


_MACRO = """
s1 AS (SELECT CAST(date_trunc('month', d) AS DATE) AS year_month, avg(idx) AS Spot_Price, avg(n) AS Order_Count
       FROM fx_index GROUP BY 1),
s2 AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS year_month, avg(l_quantity) AS Shipped FROM lineitem GROUP BY 1)"""


@query("macro_monthly_features", f"""
WITH {_MACRO},
f1 AS ({_features_sql("s1", ["Spot_Price", "Order_Count"], "year_month", _LAGS, digits=_MACRO_DIGITS)}),
f2 AS ({_features_sql("s2", ["Shipped"], "year_month", _LAGS, digits=_MACRO_DIGITS)})
SELECT * FROM f1 FULL JOIN f2 USING (year_month)""", "fx_index")
def _(t):
    prices = t.fx_index.select(F.col("d").alias("Date"), F.col("idx").alias("Spot Price"), F.col("n").alias("Order Count"))
    shipped = t.lineitem.select(F.col("l_shipdate").cast("date").alias("Date"), F.col("l_quantity").alias("Shipped"))
    return _round_averages(feeders.macro_monthly_features(prices, shipped), _MACRO_DIGITS)


_WEEKLY = {"utilization": "A", "net_input": "N", "gross_input": "R"}
_WEEKLY_DIGITS = dict.fromkeys([*_WEEKLY, "capacity"], 6)


@query("refinery_monthly_features", f"""
WITH w AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_returnflag AS k, sum(l_quantity) AS v
           FROM lineitem GROUP BY 1, 2),
c AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS d, count(*) AS v FROM orders GROUP BY 1),
{", ".join(f"m_{n} AS (SELECT CAST(date_trunc('month', d) AS DATE) AS year_month, avg(v) AS {n} FROM w WHERE k = '{k}' GROUP BY 1)"
           for n, k in _WEEKLY.items())},
m_capacity AS (SELECT CAST(date_trunc('month', d) AS DATE) AS year_month, avg(v) AS capacity FROM c GROUP BY 1),
{", ".join(f"f_{n} AS ({_features_sql('m_' + n, [n], 'year_month', digits=_WEEKLY_DIGITS)})" for n in [*_WEEKLY, "capacity"])}
SELECT * FROM f_net_input LEFT JOIN f_utilization USING (year_month) LEFT JOIN f_gross_input USING (year_month)
LEFT JOIN f_capacity USING (year_month)""")
def _(t):
    week = lambda c: F.date_trunc("week", c).cast("date").alias("Date")
    w = t.lineitem.groupBy(week("l_shipdate"), "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    series = [w.where(F.col("l_returnflag") == k).select("Date", F.col("v").alias(n)) for n, k in _WEEKLY.items()]
    capacity = t.orders.groupBy(week("o_orderdate")).agg(F.count(F.lit(1)).alias("capacity"))
    return _round_averages(feeders.refinery_monthly_features(*series, capacity), _WEEKLY_DIGITS)


@query("rig_count_features", f"""
WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, year(o_orderdate) AS y, count(*) AS v
           FROM orders GROUP BY 1, 2),
early AS (SELECT CAST(date_trunc('month', monday) AS DATE) AS year_month, avg(v) AS Rigs_Count FROM w
          WHERE v % 5 <> 0 AND date_trunc('month', monday) < DATE '1998-01-01' GROUP BY 1),
late AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS year_month, CAST(count(*) AS DOUBLE) AS Rigs_Count
         FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1),
u AS (SELECT * FROM early UNION ALL SELECT * FROM late)
{_features_sql("u", ["Rigs_Count"], "year_month", digits={"Rigs_Count": 6})}""")
def _(t):
    o = t.orders
    monday_week = F.floor((F.dayofyear("o_orderdate") + 6 - F.weekday("o_orderdate")) / 7).cast("int")
    counts = o.groupBy(monday_week.alias("Weeks"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("v"))
    cells = counts.withColumn("cell", F.when(F.col("v") % 5 == 0, " ").otherwise(F.col("v").cast("string")))
    years = years_of(o, "o_orderdate")
    weekly = cells.groupBy("Weeks").pivot("y", years).agg(F.first("cell"))
    monthly = (o.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
               .groupBy(F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("Month"))
               .agg(F.count(F.lit(1)).alias("Rigs_Count")))
    out = feeders.rig_count_features(weekly, monthly, {str(y): y for y in years}, "1998-01-01")
    return _round_averages(out, {"Rigs_Count": 6})


_SERIES = {"Series A": "series_a", "Series N": "series_n", "Series R": "series_r"}
_ROLL = "{c}_{n}_month_rolling_avg"
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _wide_sql(src: str) -> str:
    return ", ".join(f"max(CASE WHEN description = '{k}' THEN val END) AS {v}" for k, v in _SERIES.items()) + f" FROM {src}"


@query("energy_summary_features", f"""
WITH months AS (SELECT make_date(CAST(1995 + i // 12 AS INT), CAST(1 + i % 12 AS INT), 1) AS year_month FROM range(0, 84) AS r(i)),
cells AS (SELECT make_date(yyyymm // 100, yyyymm % 100, 1) AS ym, description,
                 CASE WHEN val % 7 = 0 THEN NULL ELSE val END AS val FROM fx_months),
m AS (SELECT year_month, {_wide_sql("months LEFT JOIN cells ON ym = year_month GROUP BY year_month")})
{_features_sql("m", _SERIES.values(), "year_month", name=_ROLL)}""", "fx_months")
def _(t):
    month = F.make_date(F.floor(F.col("yyyymm") / 100).cast("int"), F.col("yyyymm") % 100, F.lit(1))
    cell = F.when(F.col("val") % 7 == 0, "--").otherwise(F.col("val").cast("string"))
    cells = t.fx_months.select("description", F.date_format(month, "MMM-yy").alias("label"), cell.alias("cell"))
    # labels such as Jan-97
    labels = [f"{m}-{y % 100:02d}" for y in years_of(t.lineitem, "l_shipdate") for m in _MONTHS]
    wide = cells.groupBy("description").pivot("label", labels).agg(F.first("cell"))
    return feeders.energy_summary_features(wide, "description", labels, _SERIES)


@query("energy_long_features", f"""
WITH m AS (SELECT yyyymm, {_wide_sql("fx_long WHERE yyyymm % 100 <> 13 GROUP BY yyyymm")})
{_features_sql("m", _SERIES.values(), "yyyymm", name=_ROLL)}""", "fx_long")
def _(t):
    return feeders.energy_long_features(t.fx_long, _SERIES, "yyyymm", "description", "val")


@query("prompt_month_features", f"""
WITH m AS (SELECT d, idx AS Brent_Price, n AS Contracts FROM fx_index)
{_features_sql("m", ["Brent_Price", "Contracts"], "d", windows=(60, 90, 360), name="{c}_{n}_Day_MA")}""", "fx_index")
def _(t):
    daily = t.fx_index.select("d", F.col("idx").alias("Brent Price"), F.col("n").alias("Contracts"))
    return feeders.prompt_month_features(daily, "d")


@query("analyst_estimates", """
WITH q AS (SELECT CAST(r_regionkey AS INT) AS region, CAST(year(l_shipdate) AS INT) AS y, CAST(quarter(l_shipdate) AS INT) AS q,
             sum(l_quantity) AS units, count(*) AS deals
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
g AS (SELECT r_regionkey AS region, CAST(1995 + i // 4 AS INT) AS y, CAST(1 + i % 4 AS INT) AS q
      FROM region, range(0, 28) AS r(i))
SELECT g.region AS s_p_estimate_entity, g.y AS "s_p_estimate_Year", g.q AS "s_p_estimate_Quarter",
       round(units, 1) AS s_p_estimate_units, CAST(deals AS DOUBLE) AS s_p_estimate_deals
FROM g LEFT JOIN q ON g.region = q.region AND g.y = q.y AND g.q = q.q""")
def _(t):
    li = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
          .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
          .groupBy(F.col("n_regionkey").alias("region"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"))
          .agg(F.sum("l_quantity").alias("Units"), F.count(F.lit(1)).alias("Deals")))
    month = F.element_at(F.array(*[F.lit(m) for m in ("Mar", "Jun", "Sep", "Dec")]), F.col("q"))
    label = F.format_string("FQ%d %d - %s %d", "q", "y", month, "y")
    text = lambda c, d: F.concat(F.format_number(c, d), F.lit(" E"))
    long = li.select("region", label.alias("label"), F.explode(F.create_map(
        F.lit("Units"), text("Units", 1), F.lit("Deals"), text("Deals", 0))).alias("item", "cell"))
    labels = [f"FQ{q} {y} - {('Mar', 'Jun', 'Sep', 'Dec')[q - 1]} {y}" for y in years_of(t.lineitem, "l_shipdate") for q in range(1, 5)]
    wide = long.groupBy("region", "item").pivot("label", labels).agg(F.first("cell"))
    return feeders.company_estimates(wide.withColumn("region", F.col("region").cast("int")), "item", labels,
                                     {"Units": "units", "Deals": "deals"}, "region", "s_p_estimate_").withColumnRenamed(
        "s_p_estimate_region", "s_p_estimate_entity")


_FILING = """
filing AS (SELECT CAST(l_suppkey AS INT) AS entity, CAST(year(l_shipdate) AS INT) AS yr, CAST(quarter(l_shipdate) AS INT) AS qtr,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS update_key,
    CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS consolidated,
    CASE l_returnflag WHEN 'A' THEN 'MR' WHEN 'N' THEN 'OR' ELSE 'ZZ' END AS filing_status,
    CASE l_suppkey % 3 WHEN 0 THEN 'IAS/IFRS' WHEN 1 THEN 'US GAAP' ELSE 'OTHER' END AS accounting_standard,
    CASE WHEN l_partkey % 17 = 0 THEN 0 ELSE l_quantity END AS sales,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE floor(l_extendedprice / 1000) END AS capex,
    CAST(l_shipdate AS DATE) AS announced
  FROM lineitem WHERE l_linenumber < 7)"""


def _peer(label: str, entity: int) -> str:
    return f"""ASOF LEFT JOIN (SELECT announced_lag1 AS a_{label}, arg_max({{'s': sales_lag1}}, yr * 10 + qtr).s AS sales_lag1_{label},
    arg_max({{'c': capex_lag1}}, yr * 10 + qtr).c AS capex_lag1_{label} FROM kept WHERE entity = {entity} AND announced_lag1 IS NOT NULL
    GROUP BY announced_lag1) AS {label} ON announced_lag1 > a_{label}"""


@query("clean_panel", f"""
WITH {_FILING},
{", ".join(resolve_sql(c, "filing", "entity, yr, qtr") for c in ("sales", "capex", "announced"))},
res AS (SELECT * FROM sales_r JOIN capex_r USING (entity, yr, qtr) JOIN announced_r USING (entity, yr, qtr)),
led AS (SELECT *, lead(sales) OVER w AS sales_lag1, lead(capex) OVER w AS capex_lag1, lead(announced) OVER w AS announced_lag1,
          lead(yr) OVER w AS yr_lag1, lead(qtr) OVER w AS qtr_lag1, lag(sales, 4) OVER w AS sales_y, lag(capex, 4) OVER w AS capex_y
        FROM res WINDOW w AS (PARTITION BY entity ORDER BY yr, qtr)),
nul AS (SELECT entity, yr, qtr, NULLIF(sales, 0) AS sales, NULLIF(capex, 0) AS capex, announced, NULLIF(sales_lag1, 0) AS sales_lag1,
          NULLIF(capex_lag1, 0) AS capex_lag1, announced_lag1, yr_lag1, qtr_lag1, NULLIF(sales_y, 0) AS sales_y,
          NULLIF(capex_y, 0) AS capex_y FROM led WHERE yr_lag1 IS NOT NULL AND yr >= 1996),
kept AS (SELECT * FROM nul WHERE (capex IS NULL OR capex <> (SELECT max(capex) FROM nul))
           AND (capex_lag1 IS NULL OR capex_lag1 <> (SELECT max(capex) FROM nul))),
labels AS (SELECT CAST(s_suppkey AS INT) AS entity, n_name FROM supplier LEFT JOIN nation
           ON s_nationkey = n_nationkey AND s_acctbal > 0)
SELECT kept.entity, yr, qtr, sales, capex, announced, sales_lag1, capex_lag1, announced_lag1, yr_lag1, qtr_lag1,
  sales_y AS sales_last_year_same_quarter, capex_y AS capex_last_year_same_quarter,
  sales_lag1_p0, capex_lag1_p0, sales_lag1_p1, capex_lag1_p1, n_name AS group_num_mapped
FROM kept LEFT JOIN labels ON kept.entity = labels.entity {_peer("p0", 0)} {_peer("p1", 1)}""")
def _(t):
    p = F.col("l_partkey")
    filings = t.lineitem.select(
        F.col("l_suppkey").cast("int").alias("entity"),
        F.when(F.col("l_linenumber") == 7, F.concat(F.year("l_shipdate"), F.lit(" A")))
        .otherwise(F.concat(F.year("l_shipdate"), F.lit(" Q"), F.quarter("l_shipdate"))).alias("label"),
        F.when(p % 11 != 0, F.col("l_shipdate").cast("date")).alias("updated"),
        F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("consolidated"),
        F.when(F.col("l_returnflag") == "A", "MR").when(F.col("l_returnflag") == "N", "OR").otherwise("ZZ").alias("status"),
        F.when(F.col("l_suppkey") % 3 == 0, "IAS/IFRS").when(F.col("l_suppkey") % 3 == 1, "US GAAP")
        .otherwise("OTHER").alias("standard"),
        F.when(p % 17 == 0, 0.0).otherwise(F.col("l_quantity")).alias("sales"),
        F.when(p % 5 != 0, F.floor(F.col("l_extendedprice") / 1000).cast("double")).alias("capex"),
        F.col("l_shipdate").cast("date").alias("announced"),
        F.col("l_tax").alias("sales.1"))
    company = t.supplier.select(F.col("s_suppkey").cast("int").alias("entity"),
                                F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("group_num"))
    return panels.clean_panel(
        filings, company, t.nation, label="label", targets=["sales", "capex"], measures=[], announced="announced",
        code_maps={"group_num": ("n_nationkey", "n_name")}, code_order="n_nationkey", updated="updated",
        consolidated="consolidated", status="status", standard="standard", peers={"p0": 0, "p1": 1},
        first_year=1996, outlier="capex")


def _frames(t):
    p = t.fx_cents.select("entity", "yr", "qtr", "gappy", "qty", "sales")
    led = add_lead_targets(p, PANEL, ["sales", "gappy"])
    return panels.impute_train_test(led, ["sales", "gappy", "qty"], ["sales_lag1", "gappy_lag1"],
                                    negative=["gappy", "gappy_lag1"], cutoff=2000)


@query("impute_train_test", """
WITH src AS (SELECT * FROM (SELECT entity, yr, qtr, sales, gappy, qty, lead(sales) OVER w AS sales_lag1,
  lead(gappy) OVER w AS gappy_lag1, lead(yr) OVER w AS more FROM fx_cents
  WINDOW w AS (PARTITION BY entity ORDER BY yr, qtr)) AS x WHERE more IS NOT NULL), """ + frames_sql(
    "src", ["sales", "gappy", "qty"], ["sales_lag1", "gappy_lag1"], 2000, ["gappy", "gappy_lag1"]),
       "fx_cents", recursive=True)
def _(t):
    parts = [f.withColumn("frame", F.lit(name)) for name, f in _frames(t).items()]
    return rounded(union_rows(*parts), "sales", "gappy", "qty", "sales_lag1", "gappy_lag1", digits=3)


@query("enrich_panel", """
WITH led AS (SELECT entity, yr, qtr, announce_dt, sales, gappy, qty, CAST(lead(yr) OVER w AS INT) AS yr_lag1, CAST(lead(qtr) OVER w AS INT) AS qtr_lag1
             FROM fx_cents WINDOW w AS (PARTITION BY entity ORDER BY yr, qtr)),
mkt AS (SELECT d, idx, n, n / 100 AS risk_free_rate,
          (idx - lag(idx, 252) OVER (ORDER BY d)) / NULLIF(lag(idx, 252) OVER (ORDER BY d), 0) AS index_return FROM fx_trading_cents),
a AS (SELECT led.*, mkt.idx, mkt.n, risk_free_rate, index_return FROM led ASOF LEFT JOIN mkt ON announce_dt >= d),
b AS (SELECT a.*, coalesce(beta, 1.2) AS bt, which, (gappy - lag(gappy, 3) OVER w) / NULLIF(lag(gappy, 1) OVER w, 0) AS g FROM a
      LEFT JOIN (SELECT CAST(s_suppkey AS INT) AS entity, s_nationkey / 20.0 AS beta, s_nationkey % 2 AS which FROM supplier WHERE s_acctbal > 0) p
        ON a.entity = p.entity WINDOW w AS (PARTITION BY a.entity ORDER BY yr, qtr)),
c AS (SELECT *, risk_free_rate - bt * (index_return - risk_free_rate) AS req, CASE which WHEN 0 THEN idx WHEN 1 THEN n END AS price FROM b),
ships AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ym, avg(l_quantity) AS ship_qty FROM lineitem GROUP BY 1),
ordr AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ym, CAST(count(*) AS BIGINT) AS order_count FROM orders GROUP BY 1),
daily AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(count(*) AS BIGINT) AS lines_that_day FROM lineitem GROUP BY 1),
ops AS (SELECT entity, announce_dt, qty * 2 AS op_qty FROM fx_cents WHERE qtr <> 2),
est AS (SELECT entity, yr, qtr, sales AS c_est FROM fx_cents WHERE gappy IS NOT NULL)
SELECT c.entity, c.yr, c.qtr, c.sales, c.idx, round(risk_free_rate, 6) AS risk_free_rate, round(index_return, 6) AS index_return,
  round(req, 6) AS required_return, round(g, 6) AS dividend_growth_rate, round(price * (req - g), 3) AS "D1",
  ship_qty, order_count, lines_that_day, op_qty, -c_est AS c_est
FROM c LEFT JOIN ships ON ships.ym = date_trunc('month', c.announce_dt) LEFT JOIN ordr ON ordr.ym = date_trunc('month', c.announce_dt)
LEFT JOIN daily ON daily.d = c.announce_dt LEFT JOIN ops ON ops.entity = c.entity AND ops.announce_dt = c.announce_dt
LEFT JOIN est ON est.entity = c.entity AND est.yr = yr_lag1 AND est.qtr = qtr_lag1""", "fx_cents", "fx_index", "fx_trading_cents")
def _(t):
    # the panel is the written result of an earlier step
    base = pin(t.fx_cents.select("entity", "yr", "qtr", "announce_dt", "sales", "gappy", "qty"))
    led = add_lead_targets(base, PANEL, ["yr", "qtr"], drop_last=False)
    ships = t.lineitem.groupBy(to_month("l_shipdate").alias("year_month")).agg(F.avg("l_quantity").alias("ship qty"))
    orders = t.orders.groupBy(to_month("o_orderdate").alias("year_month")).agg(F.count(F.lit(1)).alias("order count"))
    daily = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("Date")).agg(F.count(F.lit(1)).alias("lines that day"))
    text = F.date_format("announce_dt", "dd/MM/yyyy")
    ops = base.select("entity", F.when(F.col("qtr") == 2, F.concat(text, F.lit(".1"))).otherwise(text)
                      .alias("period_ending_date"), (F.col("qty") * 2).alias("op qty"))
    est = base.where("gappy is not null").select(
        F.col("entity").alias("e_entity"), F.col("yr").alias("e_yr"), F.col("qtr").alias("e_qtr"), F.col("sales").alias("c est"))
    params = t.supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").cast("int").alias("entity"), (F.col("s_nationkey") / 20.0).alias("beta"),
        F.when(F.col("s_nationkey") % 2 == 0, "idx").otherwise("n").alias("price_col"))
    out = panels.enrich_panel(
        led, period_end="announce_dt", market=t.fx_trading_cents, market_date="d", index="idx", yield_percent="n",
        monthly=[ships, orders], daily=daily, daily_date="Date", operations=ops, operations_date="period_ending_date",
        estimates=est, estimate_keys={"yr_lag1": "e_yr", "qtr_lag1": "e_qtr", "entity": "e_entity"},
        dividend={"payout": "qty", "roe_growth": "qty", "dividend": "gappy", "shares": "qty", "prices": ["idx", "n"]},
        params=params, flip=["c est"])
    out = rounded(rounded(out, "risk_free_rate", "index_return", "required_return", "dividend_growth_rate"), "D1", digits=3)
    return out.select("entity", "yr", "qtr", "sales", "idx", "risk_free_rate", "index_return", "required_return",
                      "dividend_growth_rate", "D1", "ship_qty", "order_count", "lines_that_day", "op_qty", "c_est")


@query("select_and_forecast")
def _(t):
    report = forecasting.select_and_forecast(
        _frames(t), ["entity", "yr", "qtr"], ["sales", "gappy"], ["qtr", "qty", "sales", "gappy"], chain=["sales"],
        outlier="gappy")
    return report["summary"]


_STAT_COLS, _LEVELS = ["sales", "gappy"], ["group_label", "sector_label"]


@query("industry_statistics", "WITH x AS (SELECT p.entity, yr, qtr, sales, gappy, group_label, sector_label FROM fx_cents p "
       "LEFT JOIN fx_company c ON p.entity = c.entity), tot AS (SELECT yr, qtr, sum(sales) AS sales_industry_sum, "
       "coalesce(sum(gappy), 0) AS gappy_industry_sum FROM x GROUP BY yr, qtr), st AS (WITH "
       + _stats_sql(_STAT_COLS, _LEVELS) + ") SELECT st.*, sales_industry_sum, gappy_industry_sum FROM st "
       "JOIN tot ON st.yr = tot.yr AND st.qtr = tot.qtr", "fx_cents", "fx_company")
def _(t):
    rows = pin(t.fx_cents.select("entity", "yr", "qtr", "sales", "gappy").join(t.fx_company.drop("group_num"), "entity", "left"))
    out = panels.industry_statistics(rows, _STAT_COLS, _LEVELS, _STAT_COLS)
    out = rounded(out, *[f"{c}_{g}_std" for c in _STAT_COLS for g in _LEVELS], digits=4)
    return out.drop(*_STAT_COLS, *_LEVELS)


@query("drift_check", """
WITH v AS (SELECT yr < 1999 AS early, 'gappy' AS col, gappy AS x FROM fx_cents WHERE gappy IS NOT NULL
           UNION ALL SELECT yr < 1999, 'qty', qty FROM fx_cents),
e AS (SELECT col, min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 10 AS step FROM v WHERE early GROUP BY col),
b AS (SELECT col, i, i * step + lo AS lower, CASE WHEN i = 9 THEN hi ELSE (i + 1) * step + lo END AS upper FROM e, range(0, 10) AS r(i)),
h AS (SELECT b.col, b.i, count(CASE WHEN early THEN 1 END) AS ne, count(CASE WHEN NOT early THEN 1 END) AS na
      FROM b LEFT JOIN v ON b.col = v.col AND x >= lower AND (x < upper OR (i = 9 AND x <= upper)) GROUP BY b.col, b.i),
p AS (SELECT col, greatest(least(ne / sum(ne) OVER (PARTITION BY col), 1), 1e-10) AS pe,
             greatest(least(na / sum(na) OVER (PARTITION BY col), 1), 1e-10) AS pa FROM h),
s AS (SELECT col, sum((pe - pa) * ln(pe / pa)) AS psi FROM p GROUP BY col)
SELECT col AS "column", round(psi, 8) AS psi, psi >= 0.01 AS drifted FROM s""", "fx_cents")
def _(t):
    p = t.fx_cents
    out = panels.drift_check(p.where("yr < 1999"), p.where("yr >= 1999"), ["gappy", "qty"], alert=0.01)
    return rounded(out, "psi", digits=8)
