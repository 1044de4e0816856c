"""Revisions, priority resolution, as-of joins, windows, cross-sections, scores."""

from pyspark.sql import functions as F

from quarterdeck.operators import aggregate, asof, crosssection, drift, resolve, windows
from quarterdeck.operators.clean import parse_fiscal_period
from quarterdeck.panel import PanelSpec
from quarterdeck.session import pin
from registry.book import query, rounded

PANEL = PanelSpec.of("entity", ("yr", "qtr"))
DAYS = PanelSpec.of("entity", ("d",))
MARKET = PanelSpec.of((), ("d",))
MONTHS = PanelSpec.of((), ("year_month",))
# raw events: one user may hold any share of them, so they are worked on in blocks
EVENTS = PanelSpec.of("user_id", ("ts", "event_id"), bounded=False)


# ---- revisions and conflicting filings ------------------------------------------------

@query("latest_revision", """
SELECT entity, period, revision_id, period_end, qty, amount FROM
  (SELECT *, rank() OVER (PARTITION BY entity, period ORDER BY revision_id DESC) AS r FROM fx_rev) AS x
WHERE r = 1""", "fx_rev")
def _(t):
    return resolve.latest_revision(t.fx_rev, ["entity", "period"], "revision_id")


@query("latest_revision_join", """
WITH c AS (SELECT *, rank() OVER (PARTITION BY entity, period ORDER BY revision_id DESC) AS r FROM fx_rev
           WHERE qty > 5)
SELECT b.entity, b.period, b.tax, c.revision_id, c.qty FROM
  (SELECT l_orderkey AS entity, l_linenumber AS period, l_tax AS tax FROM lineitem WHERE l_returnflag = 'A') b
LEFT JOIN c ON b.entity = c.entity AND b.period = c.period WHERE c.r = 1""", "fx_rev")
def _(t):
    base = t.lineitem.where("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("period"), F.col("l_tax").alias("tax"))
    revised = t.fx_rev.where("qty > 5").select("entity", "period", "revision_id", "qty")
    return resolve.latest_revision_join(base, revised, ["entity", "period"], "revision_id")


def resolve_sql(col: str, src: str = "fx_filing", key: str = "entity, period") -> str:
    """The rules one after the other, as filters on the surviving rows."""
    return f"""
{col}_0 AS (SELECT {key}, {col} AS x, update_key AS d, consolidated AS c,
    CASE filing_status WHEN 'MR' THEN 1 WHEN 'OR' THEN 2 WHEN 'PR' THEN 3 WHEN 'RS' THEN 4 WHEN 'ER' THEN 5 END AS s,
    CASE accounting_standard WHEN 'IAS/IFRS' THEN 1 WHEN 'US GAAP' THEN 2 END AS a
  FROM {src} WHERE {col} IS NOT NULL),
{col}_1 AS (SELECT * FROM {col}_0 QUALIFY d = max(d) OVER (PARTITION BY {key})),
{col}_2 AS (SELECT * FROM {col}_1 QUALIFY c = 'Y' OR NOT bool_or(c = 'Y') OVER (PARTITION BY {key})),
{col}_3 AS (SELECT * FROM {col}_2 QUALIFY s = min(s) OVER (PARTITION BY {key})),
{col}_4 AS (SELECT * FROM {col}_3 QUALIFY a = min(a) OVER (PARTITION BY {key})),
{col}_r AS (SELECT {key}, coalesce(v0, v1, v2, v3, v4) AS {col} FROM (SELECT DISTINCT {key} FROM {src}) k
  {" ".join(f"LEFT JOIN (SELECT {key}, min(x) AS v{i} FROM {col}_{i} GROUP BY {key} HAVING count(DISTINCT x) = 1) t{i} USING ({key})" for i in range(5))})"""


@query("resolve_by_priority", f"""
WITH {resolve_sql("val_a")}, {resolve_sql("val_b")}
SELECT entity, period, val_a, val_b FROM val_a_r JOIN val_b_r USING (entity, period)""", "fx_filing")
def _(t):
    return resolve.resolve_by_priority(
        t.fx_filing, ["entity", "period"], ["val_a", "val_b"], "update_key", "consolidated",
        "filing_status", "accounting_standard")


#: Measures of the wide query, whose nulls follow ten patterns.
WIDE = 500


@query("resolve_wide", f"""
WITH f AS (SELECT *, CASE WHEN (val_a + p) % 10 <> 0 THEN val_a END AS v FROM fx_filing, (SELECT unnest(range(10)) AS p) AS r),
{resolve_sql("v", "f", "entity, period, p")}
SELECT entity, period, count(v) * {WIDE // 10} AS n, sum({WIDE // 10} * v + {WIDE // 10} * p + {sum(range(0, WIDE, 10))}) AS total,
       max(CASE WHEN p = 3 THEN v + 13 END) AS m13, max(CASE WHEN p = 9 THEN CAST(v + {WIDE - 1} AS VARCHAR) END) AS last
FROM v_r GROUP BY entity, period""", "fx_filing")
def _(t):
    """Hundreds of measures of all filings, of two types, resolved at once and summed up by key."""
    def measure(i):
        value = F.when((F.col("val_a") + i % 10) % 10 != 0, F.col("val_a") + i)
        return (value.cast("string") if i == WIDE - 1 else value).alias(f"m{i}")

    keys, rules = ["entity", "period"], ["update_key", "consolidated", "filing_status", "accounting_standard"]
    # a small file is one task's input, but its many cells shouldn't be one task's work
    filings = t.fx_filing.repartition(t.spark.sparkContext.defaultParallelism)
    wide = resolve.resolve_wide(filings.select(*keys, *rules, *map(measure, range(WIDE))), keys, [f"m{i}" for i in range(WIDE)], *rules)
    values = F.array_compact(F.array(*[F.col(f"m{i}").cast("double") for i in range(WIDE)]))
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return wide.select(*keys, F.size(values).cast("long").alias("n"), F.when(F.size(values) > 0, total).alias("total"),
                       "m13", F.col(f"m{WIDE - 1}").alias("last"))


@query("resolve_annual", f"""
WITH f AS (SELECT CAST(l_suppkey AS INT) AS entity, CAST(year(l_shipdate) AS INT) AS yr,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS update_key,
    CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS consolidated,
    CASE l_returnflag WHEN 'A' THEN 'MR' WHEN 'N' THEN 'OR' ELSE 'ZZ' END AS filing_status,
    CASE l_suppkey % 3 WHEN 0 THEN 'IAS/IFRS' WHEN 1 THEN 'US GAAP' ELSE 'OTHER' END AS accounting_standard,
    l_quantity AS sales FROM lineitem WHERE l_linenumber % 2 = 1),
{resolve_sql("sales", "f", "entity, yr")}
SELECT entity, yr, sales FROM sales_r""")
def _(t):
    """The annual labels of a mixed table, resolved by company and year."""
    label = F.concat(F.year("l_shipdate"), F.when(F.col("l_linenumber") % 2 == 1, " A").otherwise(F.concat(F.lit(" Q"), F.quarter("l_shipdate"))))
    filings = t.lineitem.select(
        F.col("l_suppkey").cast("int").alias("entity"), label.alias("label"), F.col("l_quantity").alias("sales"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_shipdate").cast("date")).alias("updated"),
        F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("consolidated"),
        F.when(F.col("l_returnflag") == "A", "MR").when(F.col("l_returnflag") == "N", "OR").otherwise("ZZ").alias("status"),
        F.when(F.col("l_suppkey") % 3 == 0, "IAS/IFRS").when(F.col("l_suppkey") % 3 == 1, "US GAAP").otherwise("OTHER").alias("standard"))
    return resolve.resolve_by_priority(parse_fiscal_period(filings, "label", "annual"), ["entity", "yr"], ["sales"], "updated",
                                       "consolidated", "status", "standard")


@query("revised_filing_forecast", """
WITH newest AS (SELECT * FROM (SELECT l_orderkey % 500 AS entity, l_linenumber AS period, l_suppkey % 4 AS revision_id,
    rank() OVER (PARTITION BY l_orderkey % 500, l_linenumber ORDER BY l_suppkey % 4 DESC) AS r,
    year(l_shipdate) AS d, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS c,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS s,
    CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS a, l_quantity AS x FROM lineitem) AS q WHERE r = 1),
n1 AS (SELECT * FROM newest QUALIFY d = max(d) OVER (PARTITION BY entity, period)),
n2 AS (SELECT * FROM n1 QUALIFY c = min(c) OVER (PARTITION BY entity, period)),
n3 AS (SELECT * FROM n2 QUALIFY s = min(s) OVER (PARTITION BY entity, period)),
n4 AS (SELECT * FROM n3 QUALIFY a = min(a) OVER (PARTITION BY entity, period)),
u AS (SELECT entity, period, 0 AS k, x FROM newest UNION ALL SELECT entity, period, 1, x FROM n1
      UNION ALL SELECT entity, period, 2, x FROM n2 UNION ALL SELECT entity, period, 3, x FROM n3
      UNION ALL SELECT entity, period, 4, x FROM n4),
v AS (SELECT entity, period, k, min(x) AS x FROM u GROUP BY entity, period, k HAVING count(DISTINCT x) = 1),
p AS (SELECT n.entity, n.period, arg_min(v.x, v.k) AS x FROM (SELECT DISTINCT entity, period FROM newest) n
      LEFT JOIN v ON n.entity = v.entity AND n.period = v.period GROUP BY n.entity, n.period),
l AS (SELECT entity, period, x AS pred, lead(x) OVER (PARTITION BY entity ORDER BY period) AS truth FROM p)
SELECT period, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((truth - pred) * (truth - pred))), 6) AS rmse,
       round(1 - sum((truth - pred) * (truth - pred)) / sum((truth - m) * (truth - m)), 6) AS r2
FROM (SELECT *, avg(truth) OVER (PARTITION BY period) AS m FROM l WHERE truth IS NOT NULL AND pred IS NOT NULL) AS z
GROUP BY period""")
def _(t):
    """One question end to end: how well does the last value predict the next one?"""
    raw = t.lineitem.select(
        (F.col("l_orderkey") % 500).alias("entity"), F.col("l_linenumber").alias("period"),
        (F.col("l_suppkey") % 4).alias("revision_id"), F.year("l_shipdate").alias("updated"),
        F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("consolidated"),
        F.when(F.col("l_returnflag") == "A", "MR").when(F.col("l_returnflag") == "N", "OR")
        .otherwise("ZZ").alias("status"),
        F.when(F.col("l_suppkey") % 3 == 0, "IAS/IFRS").when(F.col("l_suppkey") % 3 == 1, "US GAAP")
        .otherwise("OTHER").alias("standard"), F.col("l_quantity").alias("qty"))
    newest = resolve.latest_revision(raw, ["entity", "period"], "revision_id")
    panel = resolve.resolve_by_priority(newest, ["entity", "period"], ["qty"], "updated", "consolidated",
                                        "status", "standard")
    ahead = windows.add_lead_targets(panel, PanelSpec.of("entity", "period"), ["qty"])
    return rounded(aggregate.regression_metrics(ahead, "qty_lag1", "qty", ["period"]), "rmse", "r2")


# ---- as-of joins -----------------------------------------------------------------------

@query("asof_join_strict", """
WITH r AS (SELECT entity % 10 AS grp, announce_dt, arg_max(sales, seq * 10000000 + entity) AS peer_sales,
                  arg_max(qty, seq * 10000000 + entity) AS peer_qty
           FROM fx_panel GROUP BY entity % 10, announce_dt)
SELECT l.entity, l.yr, l.qtr, l.announce_dt, r.peer_sales, r.peer_qty FROM fx_panel l
ASOF LEFT JOIN r ON l.entity % 10 = r.grp AND l.announce_dt > r.announce_dt""", "fx_panel")
def _(t):
    p = t.fx_panel
    left = p.select("entity", "yr", "qtr", "announce_dt", (F.col("entity") % 10).alias("grp"))
    right = p.select(
        (F.col("entity") % 10).alias("r_grp"), F.col("announce_dt").alias("r_dt"), F.col("sales").alias("peer_sales"),
        F.col("qty").alias("peer_qty"), (F.col("seq") * 10000000 + F.col("entity")).alias("tie"))
    return asof.asof_join(left, right, "announce_dt", "r_dt", ["peer_sales", "peer_qty"],
                          by={"grp": "r_grp"}, strict=True, tiebreak="tie").drop("grp")


@query("asof_join_inclusive", """
SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_shipdate AS DATE) AS ship_date, m.idx, m.n
FROM lineitem l ASOF LEFT JOIN fx_trading m ON CAST(l.l_shipdate AS DATE) >= m.d""", "fx_trading")
def _(t):
    left = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ship_date"))
    return asof.asof_join(left, t.fx_trading, "ship_date", "d", ["idx", "n"], strict=False)


@query("asof_join_events", """
WITH r AS (SELECT user_id, ts, arg_max(value, event_id) AS last_value, max(event_id) AS last_id
           FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id, ts)
SELECT l.event_id, r.last_value, r.last_id FROM events l
ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.ts""")
def _(t):
    first = t.events.agg(F.min("event_type").alias("k")).scalar()
    right = t.events.where(F.col("event_type") == first).select(
        F.col("user_id").alias("r_user"), F.col("ts").alias("r_ts"), F.col("value").alias("last_value"),
        F.col("event_id").alias("last_id"))
    return asof.asof_join(t.events.select("event_id", "user_id", "ts"), right, "ts", "r_ts",
                          ["last_value", "last_id"], by={"user_id": "r_user"}, strict=True,
                          tiebreak="last_id").select("event_id", "last_value", "last_id")


def _peer_sql(label: str, entity: int) -> str:
    return f"""ASOF LEFT JOIN (SELECT announce_dt, arg_max(sales, seq) AS sales_{label}, arg_max(qty, seq) AS qty_{label}
  FROM fx_panel WHERE entity = {entity} GROUP BY announce_dt) AS {label} ON l.announce_dt > {label}.announce_dt"""


@query("peer_features", f"""
SELECT l.entity, l.yr, l.qtr, l.announce_dt, l.sales, sales_p0, qty_p0, sales_p1, qty_p1, sales_p2, qty_p2
FROM fx_panel l {_peer_sql("p0", 0)} {_peer_sql("p1", 1)} {_peer_sql("p2", 2)}""", "fx_panel")
def _(t):
    p = t.fx_panel.select("entity", "yr", "qtr", "announce_dt", "sales", "qty", "seq")
    return asof.peer_features(p, {"p0": 0, "p1": 1, "p2": 2}, "entity", "announce_dt", ["sales", "qty"],
                              tiebreak="seq").drop("seq", "qty")


# ---- aggregates ------------------------------------------------------------------------

@query("monthly_mean", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS year_month, avg(round(o_totalprice * 100)) AS o_totalprice,
       avg(o_custkey) AS o_custkey FROM orders GROUP BY 1""")
def _(t):
    cents = t.orders.withColumn("o_totalprice", F.round(F.col("o_totalprice") * 100))
    return aggregate.monthly_mean(cents, "o_orderdate", ["o_totalprice", "o_custkey"])


@query("global_extrema", """
SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, CAST(min(l_shipdate) AS DATE) AS min_l_shipdate,
       CAST(max(l_shipdate) AS DATE) AS max_l_shipdate FROM lineitem""")
def _(t):
    dated = t.lineitem.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return aggregate.global_extrema(dated, ["l_quantity", "l_shipdate"])


@query("missing_fraction", """
SELECT entity, round(avg(CASE WHEN gappy IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_gappy,
       round(avg(CASE WHEN sales IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_sales FROM fx_panel GROUP BY entity""",
       "fx_panel")
def _(t):
    return rounded(aggregate.missing_fraction(t.fx_panel, ["gappy", "sales"], ["entity"]),
                   "missing_gappy", "missing_sales")


@query("group_count", "SELECT entity, CAST(count(*) AS BIGINT) AS n_rows FROM fx_filing GROUP BY entity", "fx_filing")
def _(t):
    return aggregate.group_count(t.fx_filing, ["entity"])


_SCORE = """CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((truth - pred) * (truth - pred))), 2) AS rmse,
  round(1 - sum((truth - pred) * (truth - pred)) / sum((truth - m) * (truth - m)), 6) AS r2"""


@query("regression_metrics", f"""
SELECT {_SCORE} FROM (SELECT *, avg(truth) OVER () AS m FROM fx_pred
                      WHERE truth IS NOT NULL AND pred IS NOT NULL) AS x""", "fx_pred")
def _(t):
    return rounded(rounded(aggregate.regression_metrics(t.fx_pred, "truth", "pred"), "rmse", digits=2), "r2")


@query("regression_metrics_by_entity", f"""
SELECT entity, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((truth - pred) * (truth - pred))), 2) AS rmse,
  CASE WHEN count(*) >= 2 THEN
    round(1 - sum((truth - pred) * (truth - pred)) / sum((truth - m) * (truth - m)), 6) END AS r2
FROM (SELECT *, avg(truth) OVER (PARTITION BY entity) AS m FROM fx_pred
      WHERE truth IS NOT NULL AND pred IS NOT NULL) AS x GROUP BY entity""", "fx_pred")
def _(t):
    return rounded(rounded(aggregate.regression_metrics(t.fx_pred, "truth", "pred", ["entity"]),
                           "rmse", digits=2), "r2")


@query("quarterly_r2", f"""
SELECT yr, qtr, r2 FROM (SELECT yr, qtr, {_SCORE} FROM
  (SELECT *, avg(truth) OVER (PARTITION BY yr, qtr) AS m FROM fx_pred
   WHERE truth IS NOT NULL AND pred IS NOT NULL) AS x GROUP BY yr, qtr) AS y""", "fx_pred")
def _(t):
    return rounded(aggregate.quarterly_r2(t.fx_pred, "truth", "pred"), "r2")


_BINS = """
v AS (SELECT l_shipdate < TIMESTAMP '1999-01-01' AS early, 'l_quantity' AS col, l_quantity AS x FROM lineitem
      UNION ALL SELECT l_shipdate < TIMESTAMP '1999-01-01', 'l_extendedprice', l_extendedprice FROM lineitem),
e AS (SELECT col, min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 10 AS step FROM v WHERE early GROUP BY col),
b AS (SELECT col, CAST(i AS INT) AS bin, i * step + lo AS lower, CASE WHEN i = 9 THEN hi ELSE (i + 1) * step + lo END AS upper
      FROM e, range(0, 10) AS r(i)),
h AS (SELECT b.col, bin, lower, upper, early, count(*) AS n FROM b JOIN v ON b.col = v.col AND x >= lower
      AND (x < upper OR (bin = 9 AND x <= upper)) GROUP BY b.col, bin, lower, upper, early)"""


@query("equal_width_histogram", f"""
WITH {_BINS}
SELECT b.col AS "column", b.bin, round(b.lower, 6) AS lower, round(b.upper, 6) AS upper,
       CAST(coalesce(h.n, 0) AS BIGINT) AS n
FROM b LEFT JOIN h ON b.col = h.col AND b.bin = h.bin AND NOT early""")
def _(t):
    early, late = _halves(t)
    out = drift.equal_width_histogram(late, ["l_quantity", "l_extendedprice"], 10, early)
    return rounded(out, "lower", "upper")


def _halves(t):
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    return t.lineitem.where(F.col("l_shipdate") < cut), t.lineitem.where(F.col("l_shipdate") >= cut)


@query("population_stability_index_wide", f"""
WITH {_BINS},
c AS (SELECT b.col, b.bin, max(CASE WHEN early THEN n END) AS ne, max(CASE WHEN NOT early THEN n END) AS na
      FROM b LEFT JOIN h ON h.col = b.col AND h.bin = b.bin GROUP BY b.col, b.bin),
q AS (SELECT col, greatest(least(coalesce(ne, 0) / sum(ne) OVER (PARTITION BY col), 1), 1e-10) AS pe,
             greatest(least(coalesce(na, 0) / sum(na) OVER (PARTITION BY col), 1), 1e-10) AS pa FROM c),
s AS (SELECT col, round(sum((pe - pa) * ln(pe / pa)), 8) AS psi FROM q GROUP BY col)
SELECT 'f' || i AS "column", psi FROM s, (SELECT unnest(range(300)) AS i) AS r
WHERE col = CASE WHEN i % 2 = 0 THEN 'l_quantity' ELSE 'l_extendedprice' END""")
def _(t):
    """300 columns: each half of them is one column scaled by a power of two, which moves no row to another bin."""
    scaled = [(F.col("l_quantity" if i % 2 == 0 else "l_extendedprice") * 2.0 ** (i // 2 % 60 - 30)).alias(f"f{i}") for i in range(300)]
    early, late = (half.select(*scaled) for half in _halves(t))
    return rounded(drift.population_stability_index(early, late, [f"f{i}" for i in range(300)]), "psi", digits=8)


@query("population_stability_index", f"""
WITH {_BINS},
s AS (SELECT b.col, b.bin, CAST(coalesce(he.n, 0) AS DOUBLE) AS ne, CAST(coalesce(ha.n, 0) AS DOUBLE) AS na
      FROM b LEFT JOIN h he ON b.col = he.col AND b.bin = he.bin AND he.early
      LEFT JOIN h ha ON b.col = ha.col AND b.bin = ha.bin AND NOT ha.early),
p AS (SELECT col, greatest(least(ne / sum(ne) OVER (PARTITION BY col), 1), 1e-10) AS pe,
             greatest(least(na / sum(na) OVER (PARTITION BY col), 1), 1e-10) AS pa FROM s)
SELECT col AS "column", round(sum((pe - pa) * ln(pe / pa)), 8) AS psi FROM p GROUP BY col""")
def _(t):
    early, late = _halves(t)
    return rounded(drift.population_stability_index(early, late, ["l_quantity", "l_extendedprice"]),
                   "psi", digits=8)


# ---- windows ---------------------------------------------------------------------------

@query("add_lead_targets", """
SELECT entity, yr, qtr, sales, sales_lag1, gappy_lag1, announce_dt_lag1, yr_lag1, qtr_lag1 FROM (
  SELECT *, lead(sales) OVER w AS sales_lag1, lead(gappy) OVER w AS gappy_lag1,
         lead(announce_dt) OVER w AS announce_dt_lag1, lead(yr) OVER w AS yr_lag1, lead(qtr) OVER w AS qtr_lag1,
         row_number() OVER (PARTITION BY entity ORDER BY yr DESC, qtr DESC) AS back
  FROM fx_panel WINDOW w AS (PARTITION BY entity ORDER BY yr, qtr)) AS x WHERE back > 1""", "fx_panel")
def _(t):
    p = t.fx_panel.select("entity", "yr", "qtr", "sales", "gappy", "announce_dt")
    return windows.add_lead_targets(p, PANEL, ["sales", "gappy", "announce_dt", "yr", "qtr"]) \
        .drop("gappy", "announce_dt")


@query("add_lead_targets_events", """
SELECT event_id, value_lag1 FROM (
  SELECT event_id, lead(value) OVER w AS value_lag1, lead(1) OVER w AS more FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) AS x WHERE more = 1""")
def _(t):
    e = t.events.select("user_id", "ts", "event_id", "value")
    return windows.add_lead_targets(e, EVENTS, ["value"]).select("event_id", "value_lag1")


@query("add_year_ago", """
SELECT entity, yr, qtr, lag(sales, 4) OVER w AS sales_last_year_same_quarter,
       lag(gappy, 4) OVER w AS gappy_last_year_same_quarter
FROM fx_panel WINDOW w AS (PARTITION BY entity ORDER BY yr, qtr)""", "fx_panel")
def _(t):
    p = t.fx_panel.select("entity", "yr", "qtr", "sales", "gappy")
    return windows.add_year_ago(p, PANEL, ["sales", "gappy"]).drop("sales", "gappy")


@query("add_year_ago_calendar", """
SELECT p.entity, p.yr, p.qtr, b.sales AS sales_last_year_same_quarter FROM fx_panel p
LEFT JOIN (SELECT * FROM fx_panel WHERE gappy IS NOT NULL) b
  ON b.entity = p.entity AND b.yr = p.yr - 1 AND b.qtr = p.qtr WHERE p.gappy IS NOT NULL""", "fx_panel")
def _(t):
    holes = t.fx_panel.where("gappy is not null").select("entity", "yr", "qtr", "sales")
    return windows.add_year_ago(holes, PANEL, ["sales"], calendar=True).drop("sales")


@query("add_year_ago_days", """
SELECT entity, d, lag(amount, 4) OVER (PARTITION BY entity ORDER BY d) AS amount_4_back FROM fx_user_day""",
       "fx_user_day")
def _(t):
    return windows.add_year_ago(t.fx_user_day.select("entity", "d", "amount"), DAYS, ["amount"],
                                suffix="_4_back").drop("amount")


def _ma_sql(col: str, n: int, alias: str) -> str:
    f = f"OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {f} = {n} THEN avg({col}) {f} END AS {alias}"


@query("moving_average", f"""
SELECT entity, yr, qtr, {", ".join(_ma_sql("gappy", n, f"gappy_{n}_MA") for n in (3, 6, 12, 24))},
       {_ma_sql("sales", 3, "sales_3_MA")}, {_ma_sql("sales", 24, "sales_24_MA")}
FROM fx_cents WINDOW w AS (PARTITION BY entity ORDER BY yr, qtr)""", "fx_cents")
def _(t):
    out = windows.moving_average(t.fx_cents, PANEL, ["gappy", "sales"], name="{col}_{n}_MA")
    cols = [*[f"gappy_{n}_MA" for n in (3, 6, 12, 24)], "sales_3_MA", "sales_24_MA"]
    return out.select("entity", "yr", "qtr", *cols)


@query("moving_average_days", f"""
SELECT d, {", ".join(_ma_sql("idx", n, f"idx_{n}_day_MA") for n in (60, 90, 360))}
FROM fx_index WINDOW w AS (ORDER BY d)""", "fx_index")
def _(t):
    out = windows.moving_average(t.fx_index, MARKET, ["idx"], (60, 90, 360), "{col}_{n}_day_MA")
    return out.select("d", *[f"idx_{n}_day_MA" for n in (60, 90, 360)])


@query("moving_average_events", f"""
SELECT event_id, {_ma_sql("value", 6, "value_6_MA")}, {_ma_sql("value", 12, "value_12_MA")}
FROM (SELECT user_id, ts, event_id, round(value * 100) AS value FROM events) AS e
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    e = t.events.select("user_id", "ts", "event_id", F.round(F.col("value") * 100).alias("value"))
    out = windows.moving_average(e, EVENTS, ["value"], (6, 12), "{col}_{n}_MA")
    return out.select("event_id", "value_6_MA", "value_12_MA")


@query("rolling_average", """
SELECT entity, yr, qtr, avg(gappy) OVER (PARTITION BY entity ORDER BY yr, qtr
       ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gappy_rolling_avg_3 FROM fx_cents""", "fx_cents")
def _(t):
    out = windows.rolling_average(t.fx_cents, PANEL, ["gappy"])
    return out.select("entity", "yr", "qtr", "gappy_rolling_avg_3")


def _ema_sql(src: str, keys: str, part: str, order: str, x: str, a: str = "0.5::DOUBLE", b: str = "0.5::DOUBLE") -> str:
    """One step per row: the past decays by ``b`` = 1 - a, an observation weighs ``a``."""
    return f"""
n AS (SELECT {keys}, {part} AS e, {x} AS x, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS i FROM {src}),
walk AS (SELECT {keys}, e, i, CAST(x AS DOUBLE) AS v, 1.0::DOUBLE AS w FROM n WHERE i = 1
  UNION ALL
  SELECT {", ".join("n." + k.strip() for k in keys.split(","))}, n.e, n.i,
    CASE WHEN n.x IS NULL THEN walk.v WHEN walk.v IS NULL THEN n.x
         ELSE ({b} * walk.w * walk.v + {a} * n.x) / ({b} * walk.w + {a}) END,
    CASE WHEN n.x IS NULL AND walk.v IS NOT NULL THEN {b} * walk.w ELSE 1.0 END
  FROM walk JOIN n ON n.e = walk.e AND n.i = walk.i + 1)"""


@query("ema", f"""
WITH {_ema_sql("fx_panel", "entity, yr, qtr", "entity", "yr, qtr", "gappy")}
SELECT entity, yr, qtr, v AS gappy_ema_3 FROM walk""", "fx_panel", recursive=True)
def _(t):
    return windows.ema(t.fx_panel.select("entity", "yr", "qtr", "gappy"), PANEL, ["gappy"], 3).drop("gappy")


@query("ema_days", f"""
WITH {_ema_sql("fx_user_day", "entity, d", "entity", "d", "amount")}
SELECT entity, d, v AS amount_ema_3 FROM walk""", "fx_user_day", recursive=True)
def _(t):
    return windows.ema(t.fx_user_day.select("entity", "d", "amount"), DAYS, ["amount"], 3).drop("amount")


@query("ema_events", f"""
WITH RECURSIVE {_ema_sql("(SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS seen FROM events) AS s",
                         "event_id", "user_id", "ts, event_id", "seen", "(2.0::DOUBLE / 7)", "(1 - 2.0::DOUBLE / 7)")}
SELECT event_id, round(v, 6) AS seen_ema_6 FROM walk""")
def _(t):
    e = t.events.select("user_id", "ts", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("seen"))
    return rounded(windows.ema(e, EVENTS, ["seen"], 6).select("event_id", "seen_ema_6"), "seen_ema_6")


@query("first_difference", """
SELECT entity, yr, qtr, round(sales - lag(sales) OVER w, 4) AS sales_q2q_diff,
       round(gappy - lag(gappy) OVER w, 4) AS gappy_q2q_diff
FROM fx_panel WINDOW w AS (PARTITION BY entity ORDER BY yr, qtr)""", "fx_panel")
def _(t):
    out = windows.first_difference(t.fx_panel, PANEL, ["sales", "gappy"])
    cols = ["sales_q2q_diff", "gappy_q2q_diff"]
    return rounded(out.select("entity", "yr", "qtr", *cols), *cols, digits=4)


def _growth_sql(src: str, keys: str, part: str, order: str, x: str, name: str) -> str:
    return f"""
f AS (SELECT *, last_value({x} IGNORE NULLS) OVER w AS ff, first_value({x} IGNORE NULLS) OVER w AS f0,
        max(CASE WHEN {x} = 0 THEN 1 ELSE 0 END) OVER w AS z
      FROM {src} WINDOW w AS (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, lag(ff) OVER w AS base, coalesce(lag(z) OVER w, 0) AS zb FROM f
      WINDOW w AS (PARTITION BY {part} ORDER BY {order}))
SELECT {keys}, round((ff / NULLIF(base, 0) - 1) * 100, 6) AS {name}_q2q_pct_change,
       round(CASE WHEN base IS NOT NULL AND zb = 0 THEN ff / f0 END, 6) AS {name}_q2q_cumulative_growth FROM g"""


@query("growth_rate", "WITH " + _growth_sql("fx_panel", "entity, yr, qtr", "entity", "yr, qtr", "gappy", "gappy"),
       "fx_panel")
def _(t):
    out = windows.growth_rate(t.fx_panel.select("entity", "yr", "qtr", "gappy"), PANEL, ["gappy"]).drop("gappy")
    return rounded(out, "gappy_q2q_pct_change", "gappy_q2q_cumulative_growth")


@query("growth_rate_events", "WITH s AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL "
       "WHEN event_id % 97 = 1 THEN 0 ELSE value END AS x FROM events), "
       + _growth_sql("s", "event_id", "user_id", "ts, event_id", "x", "x"))
def _(t):
    i = F.col("event_id")
    e = t.events.select("user_id", "ts", "event_id", F.when(i % 5 == 0, F.lit(None)).when(i % 97 == 1, 0.0)
                        .otherwise(F.col("value")).alias("x"))
    out = windows.growth_rate(e, EVENTS, ["x"]).drop("x", "user_id", "ts")
    return rounded(out, "x_q2q_pct_change", "x_q2q_cumulative_growth")


_LAGS = (1, 2, 3, 4, 5, 6, 12, 24)


@query("add_lags", f"""
WITH m AS (SELECT CAST(date_trunc('month', d) AS DATE) AS year_month, avg(idx) AS idx FROM fx_index GROUP BY 1)
SELECT year_month, {", ".join(f"lag(idx, {k}) OVER (ORDER BY year_month) AS idx_lag_{k}_month" for k in _LAGS)}
FROM m""", "fx_index")
def _(t):
    return windows.add_lags(aggregate.monthly_mean(t.fx_index, "d", ["idx"]), MONTHS, ["idx"]).drop("idx")


@query("period_return", """
SELECT d, round((idx - lag(idx, 252) OVER (ORDER BY d)) / NULLIF(lag(idx, 252) OVER (ORDER BY d), 0), 6) AS idx_return
FROM fx_market""", "fx_market")
def _(t):
    return rounded(windows.period_return(t.fx_market, MARKET, "idx").select("d", "idx_return"), "idx_return")


@query("scaled_difference", """
SELECT entity, yr, qtr, round((gappy - lag(gappy, 3) OVER w) / NULLIF(lag(gappy, 1) OVER w, 0), 6) AS gappy_scaled_diff
FROM fx_panel WINDOW w AS (PARTITION BY entity ORDER BY yr, qtr)""", "fx_panel")
def _(t):
    out = windows.scaled_difference(t.fx_panel, PANEL, "gappy").select("entity", "yr", "qtr", "gappy_scaled_diff")
    return rounded(out, "gappy_scaled_diff")


# ---- cross-sections --------------------------------------------------------------------

def _stats_sql(cols, groups) -> str:
    parts, joins, out = [], [], []
    for g in groups:
        aggs = ", ".join(
            f"avg({c}) AS {c}_{g}_mean, median({c}) AS {c}_{g}_median, min({c}) AS {c}_{g}_min, "
            f"max({c}) AS {c}_{g}_max, round(stddev_samp({c}), 4) AS {c}_{g}_std, "
            f"quantile_cont({c}, 0.25) AS {c}_{g}_q1, quantile_cont({c}, 0.75) AS {c}_{g}_q3" for c in cols)
        parts.append(f"s_{g} AS (SELECT yr, qtr, {g}, {aggs} FROM x WHERE {g} IS NOT NULL GROUP BY yr, qtr, {g})")
        joins.append(f"LEFT JOIN s_{g} ON x.yr = s_{g}.yr AND x.qtr = s_{g}.qtr AND x.{g} = s_{g}.{g}")
        for c in cols:
            for s in ("mean", "median", "min", "max", "std", "q1", "q3"):
                n = f"{c}_{g}_{s}"
                out.append(n)
    return (", ".join(parts) + " SELECT x.entity, x.yr, x.qtr, " + ", ".join(out) + " FROM x " + " ".join(joins))


_STAT_COLS, _LEVELS = ["sales", "gappy"], ["group_label", "sector_label"]


def _with_labels(t):
    # the panel is the written result of an earlier step
    return pin(t.fx_cents.select("entity", "yr", "qtr", "sales", "gappy").join(t.fx_company, "entity", "left"))


def _round_stats(out):
    cols = [f"{c}_{g}_std" for c in _STAT_COLS for g in _LEVELS]
    return rounded(out.drop(*_STAT_COLS, *_LEVELS, "group_num"), *cols, digits=4)


_STATS = ("WITH x AS (SELECT p.entity, yr, qtr, sales, gappy, group_label, sector_label FROM fx_cents p "
          "LEFT JOIN fx_company c ON p.entity = c.entity), " + _stats_sql(_STAT_COLS, _LEVELS))


@query("group_statistics", _STATS, "fx_cents", "fx_company")
def _(t):
    return _round_stats(crosssection.group_statistics(_with_labels(t), _STAT_COLS, _LEVELS, ["yr", "qtr"]))


@query("group_statistics_large_groups", _STATS, "fx_cents", "fx_company")
def _(t):
    """The same answer where some groups count as too large for one task."""
    return _round_stats(crosssection.group_statistics(_with_labels(t), _STAT_COLS, _LEVELS, ["yr", "qtr"],
                                                      group_limit=10))


@query("group_statistics_merged", """
WITH v AS (SELECT CAST(year(l_shipdate) AS INT) AS yr, l_returnflag, 'l_quantity' AS measure, CAST(l_quantity AS DOUBLE) AS x FROM lineitem
  UNION ALL SELECT CAST(year(l_shipdate) AS INT), l_returnflag, 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM lineitem)
SELECT yr, l_returnflag, measure, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 5) AS std, min(x) AS low, max(x) AS high, true AS close
FROM v GROUP BY yr, l_returnflag, measure""")
def _(t):
    """States of the lines that came first and of those that came later, merged; ``close`` tells whether the quartiles' ranks are within 1 %."""
    by, cols = ["yr", "l_returnflag"], ["l_quantity", "l_extendedprice"]
    lines = t.lineitem.select(F.year("l_shipdate").alias("yr"), "l_returnflag", "l_linenumber", *cols)
    states = [crosssection.statistic_states(lines.where(part), cols, by) for part in ("l_linenumber <= 3", "l_linenumber > 3")]
    found = pin(crosssection.statistics_of(crosssection.merge_states(states[0].unionByName(states[1]), by), by), "merged")
    long = lines.unpivot(by, cols, "measure", "x").join(found, [*by, "measure"])
    near = [(F.avg((F.col("x") < F.col(c)).cast("double")) <= p + 0.01) & (F.avg((F.col("x") <= F.col(c)).cast("double")) >= p - 0.01)
            for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    close = long.groupBy(*by, "measure").agg((near[0] & near[1] & near[2]).alias("close"))
    out = found.join(close, [*by, "measure"]).select(*by, "measure", "n", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"), "low", "high", "close")
    return out


@query("group_quantiles_by_narrowing", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    """The quartiles of group_statistics for groups too large for one task."""
    q = crosssection.group_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", group_limit=1000)
    out = q.select("l_returnflag", *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    return rounded(out, "q1", "median", "q3", digits=4)


@query("period_total", """
SELECT entity, yr, qtr, sum(sales) OVER (PARTITION BY yr, qtr) AS sales_industry_sum,
       coalesce(sum(gappy) OVER (PARTITION BY yr, qtr), 0) AS gappy_industry_sum FROM fx_cents""", "fx_cents")
def _(t):
    out = crosssection.period_total(t.fx_cents, ["sales", "gappy"], ["yr", "qtr"])
    return out.select("entity", "yr", "qtr", "sales_industry_sum", "gappy_industry_sum")
