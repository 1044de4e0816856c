"""Row filters, cleaning, scalar features and output order."""

from pyspark.sql import functions as F

from quarterdeck.functions.dates import month_of, parse_date, to_month
from quarterdeck.functions.numeric import parse_numeric_text
from quarterdeck.operators import clean, derive, sorting
from quarterdeck.operators.reshape import union_rows
from quarterdeck.panel import PanelSpec
from registry.book import query, rounded

PANEL = PanelSpec.of("entity", ("yr", "qtr"))


@query("parse_fiscal_period", """
SELECT 'quarter' AS kind, entity, yr, qtr, sales FROM fx_panel
UNION ALL SELECT 'annual', entity, yr, CAST(NULL AS INT), sales FROM fx_panel
UNION ALL SELECT 'estimate', entity, yr, qtr, sales FROM fx_panel""", "fx_panel")
def _(t):
    p = t.fx_panel
    labels = {
        "quarter": F.format_string("%d Q%d", "yr", "qtr"),
        "annual": F.format_string("%d A", "yr"),
        "estimate": F.format_string("FQ%d %d - Sep %d", "qtr", "yr", "yr")}
    # every frame holds labels of all kinds, and null ones, of which one kind is kept
    mixed = p.withColumn("label", F.explode(F.array(*labels.values(), F.lit(None).cast("string"))))
    mixed = mixed.select("entity", "sales", "label")
    parts = [clean.parse_fiscal_period(mixed, "label", kind).withColumn("kind", F.lit(kind))
             for kind in labels]
    return union_rows(*parts).select("kind", "entity", "yr", "qtr", "sales")


@query("parse_date", """
SELECT d, d AS d_compact, d AS d_iso, d AS d_slash, CAST(date_trunc('month', d) AS DATE) AS m_dash,
       CAST(date_trunc('month', d) AS DATE) AS m_compact, CAST(date_trunc('month', d) AS DATE) AS m_short,
       CAST(date_trunc('month', d) AS DATE) AS m_text, CAST(date_trunc('week', d) AS DATE) AS w_monday,
       CAST(date_trunc('month', d) AS DATE) AS m_parts, CAST(NULL AS DATE) AS bad
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) AS x""")
def _(t):
    d = t.lineitem.select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    week = F.floor((F.dayofyear("d") + 6 - F.weekday("d")) / 7)
    text = {
        "d_compact": (F.date_format("d", "yyyyMMdd"), "yyyyMMdd"),
        "d_iso": (F.date_format("d", "yyyy-MM-dd"), "yyyy-MM-dd"),
        "d_slash": (F.date_format("d", "dd/MM/yyyy"), "dd/MM/yyyy"),
        "m_dash": (F.date_format("d", "yyyy-MM"), "yyyy-MM"),
        "m_compact": (F.date_format("d", "yyyyMM"), "yyyyMM"),
        "m_short": (F.concat(F.year("d"), F.month("d")), "yyyyMM"),
        "m_text": (F.date_format("d", "MMM-yy"), "MMM-yy"),
        "w_monday": (F.concat(F.year("d"), week), "year-week"),
        "bad": (F.date_format("d", "dd.MM.yyyy"), "yyyy-MM-dd")}
    return d.select("d", *[parse_date(c, fmt).alias(n) for n, (c, fmt) in text.items()],
                    month_of(F.year("d"), F.month("d")).alias("m_parts"))


@query("to_month", """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS o_month FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", to_month("o_orderdate").alias("o_month"))


@query("sentinels_to_null", """
SELECT NULLIF(l_orderkey, 0) AS l_orderkey, NULLIF(l_discount, 0) AS l_discount, NULLIF(l_tax, 0) AS l_tax,
       CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'N' THEN NULL ELSE '0' END AS flag,
       CASE WHEN l_quantity > 45 OR l_quantity < 5 THEN NULL ELSE l_quantity END AS qty
FROM lineitem""")
def _(t):
    dirty = t.lineitem.select(
        "l_orderkey", "l_discount", "l_tax",
        F.when(F.col("l_returnflag") == "A", "NULL").when(F.col("l_returnflag") == "N", "--")
        .otherwise("0").alias("flag"),
        F.when(F.col("l_quantity") > 45, float("inf")).when(F.col("l_quantity") < 5, float("nan"))
        .otherwise(F.col("l_quantity")).alias("qty"))
    return clean.sentinels_to_null(dirty)


@query("parse_numeric_text", """
SELECT o_orderkey, round(o_totalprice, 2) AS price, CAST(NULL AS DOUBLE) AS dashes FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey",
        parse_numeric_text(F.concat(F.format_number("o_totalprice", 2), F.lit(" E"))).alias("price"),
        parse_numeric_text(F.lit("--")).alias("dashes"))


@query("filter_rows", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-06-01'
  AND l_quantity >= 10""")
def _(t):
    df = clean.filter_in(t.lineitem, "l_returnflag", ["A", "R"])
    df = clean.filter_between_dates(df, "l_shipdate", "1996-01-01", "1999-06-01")
    df = clean.filter_from(df, "l_quantity", 10.0)
    return df.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity",
                     F.col("l_shipdate").cast("date").alias("ship_date"))


@query("drop_annual_totals", "SELECT yyyymm, description, val FROM fx_long WHERE yyyymm % 100 <> 13", "fx_long")
def _(t):
    return clean.drop_annual_totals(t.fx_long, "yyyymm").select("yyyymm", "description", "val")


@query("drop_suffixed_values", """
SELECT entity, strftime(announce_dt, '%d/%m/%Y') AS period_ending_date, sales FROM fx_panel WHERE qtr <> 2""",
       "fx_panel")
def _(t):
    text = F.date_format("announce_dt", "dd/MM/yyyy")
    odd = t.fx_panel.select("entity", F.when(F.col("qtr") == 2, F.concat(text, F.lit(".1")))
                            .otherwise(text).alias("period_ending_date"), "sales")
    return clean.drop_suffixed_values(odd, "period_ending_date")


@query("drop_max_outlier", """
SELECT l_orderkey, l_linenumber, l_quantity, next_quantity FROM
  (SELECT *, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_partkey % 51 AS DOUBLE) END AS next_quantity
   FROM lineitem) AS x
WHERE l_quantity <> (SELECT max(l_quantity) FROM lineitem)
  AND (next_quantity IS NULL OR next_quantity <> (SELECT max(l_quantity) FROM lineitem))""")
def _(t):
    nxt = F.when(F.col("l_partkey") % 13 != 0, (F.col("l_partkey") % 51).cast("double"))
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", nxt.alias("next_quantity"))
    return clean.drop_max_outlier(df, "l_quantity", ["next_quantity"])


@query("drop_rows_containing", """
WITH top AS (SELECT max(l_quantity) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')
SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM lineitem, top
WHERE l_orderkey <> v AND l_suppkey <> v AND l_linenumber <> v AND l_quantity <> v""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    train = t.lineitem.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return clean.drop_rows_containing(df, train, "l_quantity")


@query("drop_null_rows", """
SELECT entity, period, val_a, val_b FROM fx_filing WHERE val_a IS NOT NULL AND val_b IS NOT NULL""", "fx_filing")
def _(t):
    return clean.drop_null_rows(t.fx_filing, ["val_a", "val_b"]).select("entity", "period", "val_a", "val_b")


@query("flip_sign", "SELECT entity, yr, qtr, -sales AS sales, -gappy AS gappy FROM fx_panel", "fx_panel")
def _(t):
    return clean.flip_sign(t.fx_panel.select("entity", "yr", "qtr", "sales", "gappy"), ["sales", "gappy"])


@query("map_codes", """
WITH dim AS (SELECT n_nationkey AS code, n_name AS label, 1 AS pos FROM nation
             UNION ALL SELECT n_nationkey, concat('new ', n_name), 2 FROM nation),
last_label AS (SELECT code, arg_max(label, pos) AS label FROM dim GROUP BY code),
c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_nationkey + 100 ELSE c_nationkey END AS nation_code FROM customer)
SELECT c_custkey, nation_code, label AS nation_code_mapped FROM c LEFT JOIN last_label ON nation_code = code""")
def _(t):
    label = lambda text, pos: t.nation.select(F.col("n_nationkey").alias("code"), text.alias("label"), F.lit(pos).alias("pos"))
    dim = label(F.col("n_name"), 1).unionByName(label(F.concat(F.lit("new "), "n_name"), 2))
    code = F.when(F.col("c_acctbal") < 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey"))
    return clean.map_codes(t.customer.select("c_custkey", code.alias("nation_code")), dim,
                           {"nation_code": ("code", "label")}, "pos")


@query("select_features", """
SELECT p_partkey, p_brand AS brand, p_size, p_retailprice, 'catalog' AS source FROM part""")
def _(t):
    return clean.select_features(t.part, ["p_name", "p_type"], {"p_brand": "brand"}, {"source": "catalog"})


@query("cast_numeric", """
SELECT o_orderkey, CAST(o_totalprice AS FLOAT) + 0.0::DOUBLE AS price,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS cust FROM orders""")
def _(t):
    text = F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_custkey").cast("string"))
    df = t.orders.select("o_orderkey", F.col("o_totalprice").cast("float").alias("price"), text.alias("cust"))
    return clean.cast_numeric(clean.cast_numeric(df), ["cust"])


@query("index_categories", """
WITH seen AS (SELECT concat(l_returnflag, CAST(year(l_shipdate) AS VARCHAR)) AS label, count(*) AS n
              FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1),
idx AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS i FROM seen)
SELECT l_orderkey, l_linenumber, coalesce(i, (SELECT CAST(count(*) AS DOUBLE) FROM seen)) AS kind_index
FROM lineitem LEFT JOIN idx ON label = concat(l_returnflag, CAST(year(l_shipdate) AS VARCHAR))""")
def _(t):
    """Fitted on the early years: the kinds of later years are unseen."""
    df = t.lineitem.withColumn("kind", F.concat("l_returnflag", F.year("l_shipdate").cast("string")))
    train = df.where(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    model = clean.index_categories(train, ["kind"])
    return model.transform(df.select("l_orderkey", "l_linenumber", "kind")).drop("kind")


@query("distinct_keys", "SELECT DISTINCT l_suppkey FROM lineitem")
def _(t):
    return clean.distinct_keys(t.lineitem, "l_suppkey")


@query("log_features", """
SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS l_extendedprice_log,
       round(CASE WHEN l_discount > 0 THEN ln(l_discount) END, 6) AS l_discount_log FROM lineitem""")
def _(t):
    df = derive.log_features(t.lineitem, ["l_extendedprice", "l_discount"])
    return rounded(df.select("l_orderkey", "l_linenumber", "l_extendedprice_log", "l_discount_log"),
                   "l_extendedprice_log", "l_discount_log")


@query("interaction_features", """
SELECT l_orderkey, l_linenumber,
       round(l_quantity / NULLIF(l_discount, 0), 6) AS l_quantity_over_l_discount,
       round(l_quantity * l_discount, 6) AS l_quantity_times_l_discount,
       round(l_quantity / NULLIF(l_tax, 0), 6) AS l_quantity_over_l_tax,
       round(l_quantity * l_tax, 6) AS l_quantity_times_l_tax,
       round(l_discount / NULLIF(l_tax, 0), 6) AS l_discount_over_l_tax,
       round(l_discount * l_tax, 6) AS l_discount_times_l_tax
FROM lineitem""")
def _(t):
    cols = ["l_quantity", "l_discount", "l_tax"]
    df = derive.interaction_features(t.lineitem.select("l_orderkey", "l_linenumber", *cols), cols).drop(*cols)
    return rounded(df, *[c for c in df.columns if "_over_" in c or "_times_" in c])


@query("dividend_estimate", """
WITH x AS (
  SELECT entity, yr, qtr, qty / 10000 AS rf, sales / 10000000 AS mkt, CAST((seq % 7) * 10 AS DOUBLE) AS payout,
         sales / 1000000 AS roe, gappy / 100000 AS dps, qty AS shares, sales / 1000 AS price_a, qty * 2 AS price_b,
         lag(gappy / 100000, 1) OVER w AS d1, lag(gappy / 100000, 3) OVER w AS d3
  FROM fx_panel WINDOW w AS (PARTITION BY entity ORDER BY yr, qtr)),
p AS (SELECT CAST(s_suppkey AS INT) AS entity, s_nationkey / 20.0 AS beta, s_nationkey % 2 AS which
      FROM supplier WHERE s_acctbal > 0),
y AS (SELECT x.*, (dps - d3) / NULLIF(d1, 0) AS g, rf - coalesce(beta, 1.2) * (mkt - rf) AS req,
             (1 - payout / 100) * roe AS goe,
             CASE which WHEN 0 THEN price_a WHEN 1 THEN price_b END AS price
      FROM x LEFT JOIN p ON x.entity = p.entity)
SELECT entity, yr, qtr, round(req, 6) AS required_return, round(goe, 10) AS growth_of_equity,
       round(g, 6) AS dividend_growth_rate, round(price * (req - g), 4) AS "D1",
       round(price * (req - g) * shares, 2) AS "total_D1",
       round(price * (req - g) * shares / NULLIF(payout / 100, 0), 2) AS "estimated_NI_wD1"
FROM y""", "fx_panel")
def _(t):
    p = t.fx_panel.select(
        "entity", "yr", "qtr", (F.col("qty") / 10000).alias("rf"), (F.col("sales") / 10000000).alias("mkt"),
        ((F.col("seq") % 7) * 10).cast("double").alias("payout"), (F.col("sales") / 1000000).alias("roe"),
        (F.col("gappy") / 100000).alias("dps"), F.col("qty").alias("shares"),
        (F.col("sales") / 1000).alias("price_a"), (F.col("qty") * 2).alias("price_b"))
    params = t.supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").cast("int").alias("entity"), (F.col("s_nationkey") / 20.0).alias("beta"),
        F.when(F.col("s_nationkey") % 2 == 0, "price_a").otherwise("price_b").alias("price_col"))
    out = derive.dividend_estimate(
        p, PANEL, params, risk_free="rf", market_return="mkt", payout="payout", roe_growth="roe",
        dividend="dps", shares="shares", prices=["price_a", "price_b"])
    out = rounded(rounded(out, "required_return", "dividend_growth_rate"), "growth_of_equity", digits=10)
    out = rounded(rounded(out, "D1", digits=4), "total_D1", "estimated_NI_wD1", digits=2)
    return out.select("entity", "yr", "qtr", "required_return", "growth_of_equity", "dividend_growth_rate",
                      "D1", "total_D1", "estimated_NI_wD1")


@query("scale_percent", "SELECT l_orderkey, l_linenumber, l_quantity / 100 AS rate FROM lineitem")
def _(t):
    return derive.scale_percent(t.lineitem, {"l_quantity": "rate"}).select("l_orderkey", "l_linenumber", "rate")


@query("sort_rows", "SELECT entity, yr, qtr, sales FROM fx_panel ORDER BY entity, yr, qtr", "fx_panel")
def _(t):
    return sorting.sort_rows(t.fx_panel.select("entity", "yr", "qtr", "sales"), "entity", "yr", "qtr")


@query("head_rows", "SELECT entity, yr, qtr, sales FROM fx_panel ORDER BY entity, yr, qtr LIMIT 5", "fx_panel")
def _(t):
    return sorting.head_rows(t.fx_panel.select("entity", "yr", "qtr", "sales"), ["entity", "yr", "qtr"], 5)


@query("top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return sorting.top_rows(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")
