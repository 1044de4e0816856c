"""Feature ranking, forecasts, back-tests and searches with Spark ML.

The learners are Spark's own, so most of these have no SQL counterpart; what is
exact (folds, report order) has.
"""

from pyspark.sql import functions as F

from quarterdeck.operators import folds, forecast, selection, sorting
from quarterdeck.operators.aggregate import regression_metrics
from quarterdeck.operators.joins import join_dimension
from quarterdeck.operators.windows import add_lead_targets, add_year_ago, rolling_average
from quarterdeck.panel import PanelSpec
from quarterdeck.session import pin
from registry.book import query, rounded

PANEL = PanelSpec.of("entity", ("yr", "qtr"))
KEYS = ["entity", "yr", "qtr"]
ORDER = ["yr", "qtr", "entity"]
FEATURES = ["qtr", "sales", "qty", "gappy", "sales_last_year_same_quarter", "qty_last_year_same_quarter",
            "sales_rolling_avg_3", "qty_rolling_avg_3", "seq"]
CATEGORICAL = ["sector_label"]
SMALL = forecast.Booster(rounds=3, learning_rate=0.1, depth=3)


def model_frame(t):
    """Panel features with the next quarter's sales and quantity as targets."""
    p = add_year_ago(t.fx_panel, PANEL, ["sales", "qty"])
    p = rolling_average(p, PANEL, ["sales", "qty"])
    p = add_lead_targets(p, PANEL, ["sales", "qty"])
    p = join_dimension(p, t.fx_company, "entity", ["sector_label"])
    return pin(p.select(*KEYS, *[c for c in FEATURES if c not in KEYS], *CATEGORICAL, "sales_lag1", "qty_lag1"), "model")


def _parts(t, cutoff=2000):
    p = model_frame(t)
    return p.where(F.col("yr") < cutoff), p.where(F.col("yr") >= cutoff)


def _metrics(f):
    return rounded(f.metrics(), "rmse", "r2")


def _with_refit(table, chosen, fit):
    """What a search tried, and at what it chose the scores of the refit on the test rows."""
    score = rounded(regression_metrics(fit.test, "sales_lag1", "pred_sales_lag1"), "rmse", "r2")
    table = table.withColumn("chosen", chosen)
    return table.withColumns({f"test_{c}": F.when(F.col("chosen"), score.select(c).scalar()) for c in ("rmse", "r2")})


@query("rank_features")
def _(t):
    train, _ = _parts(t)
    return forecast.rank_features(train, "sales_lag1", [*FEATURES, *CATEGORICAL], CATEGORICAL)


@query("top_features", """
SELECT feature, importance FROM
  (SELECT p_type AS feature, CAST(sum(p_size) AS DOUBLE) AS importance FROM part GROUP BY p_type) AS x
ORDER BY importance DESC, feature LIMIT 10""")
def _(t):
    gains = t.part.groupBy(F.col("p_type").alias("feature")).agg(F.sum("p_size").cast("double").alias("importance"))
    return sorting.top_features(gains, 10)


@query("search_feature_count")
def _(t):
    train, test = _parts(t)
    ranked = ["qty", "sales_rolling_avg_3", "sales_last_year_same_quarter", "qtr", "gappy", "qty_rolling_avg_3"]
    s = selection.search_feature_count(train, test, "sales_lag1", "sales", ranked)
    rows = [(n, e, n == s.count) for n, e in sorted(s.scores.items())]
    return t.spark.createDataFrame(rows, "num_features int, rmse double, chosen boolean")


@query("forecast_targets")
def _(t):
    train, test = _parts(t)
    out = selection.forecast_targets(train, test, ["sales", "qty"], [*FEATURES, *CATEGORICAL], CATEGORICAL, chain=["sales"])
    return out["qty"].forecast.test.select(*KEYS, "qty_lag1", "pred_sales_lag1", "pred_qty_lag1")


@query("forecast_report")
def _(t):
    train, test = _parts(t)
    out = selection.forecast_targets(train, test, ["sales", "qty"], FEATURES)
    return selection.forecast_report(out, KEYS)["summary"]


@query("boosted_forecast")
def _(t):
    train, test = _parts(t)
    return _metrics(forecast.boosted_forecast(train, test, "sales_lag1", [*FEATURES, *CATEGORICAL], CATEGORICAL))


# Boosting that uses all rows, on a feature of few values, has a known answer at any number of rounds: the first
# tree predicts the mean of each value, and what is left for the others has mean zero. SQL can state it.
_LED = """
led AS (SELECT *, lead(sales) OVER w AS y, lead(yr) OVER w AS more FROM fx_panel WINDOW w AS (PARTITION BY entity ORDER BY yr, qtr)),
m AS (SELECT entity, yr, qtr, y FROM led WHERE more IS NOT NULL)"""
_SCORES = """count(*) AS n, round(sqrt(sum((y - p) * (y - p)) / count(*)), 4) AS rmse,
       round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2"""


def _scores(df):
    return df.withColumns({"rmse": F.round("rmse", 4), "r2": F.round("r2", 6)})


@query("boosted_forecast_by_label", f"""
WITH {_LED}, l AS (SELECT m.*, coalesce(sector_label, '') AS label FROM m LEFT JOIN fx_company c ON m.entity = c.entity),
means AS (SELECT label, avg(y) AS p FROM l WHERE yr < 2000 GROUP BY label)
SELECT CASE WHEN yr < 2000 THEN 'train' ELSE 'test' END AS part, {_SCORES}
FROM l JOIN means USING (label) WHERE y IS NOT NULL GROUP BY 1""", "fx_panel", "fx_company")
def _(t):
    """A category alone: the forecast is the mean of each label."""
    train, test = _parts(t)
    return _scores(forecast.boosted_forecast(train, test, "sales_lag1", CATEGORICAL, CATEGORICAL, forecast.BACKTEST_DEFAULTS).metrics())


@query("forecast_report_predictions", f"""
WITH {_LED}, q AS (SELECT entity, yr, qtr, lead(qty) OVER w AS y, lead(yr) OVER w AS more FROM fx_panel
                   WINDOW w AS (PARTITION BY entity ORDER BY yr, qtr))
SELECT 'sales' AS target, entity, yr, qtr, y AS truth, true AS predicted FROM m WHERE yr >= 2000
UNION ALL SELECT 'qty', entity, yr, qtr, y, true FROM q WHERE more IS NOT NULL AND yr >= 2000""", "fx_panel")
def _(t):
    """The rows of the report: each target, key and truth, and that there is a prediction; counts chosen on held-back rows."""
    train, test = _parts(t)
    out = selection.forecast_targets(train.where("yr < 1999"), test, ["sales", "qty"], FEATURES, chain=["sales"],
                                     ranking=forecast.Booster(rounds=2, loss="absolute", depth=3), settings=SMALL, first=3, step=3,
                                     validation=train.where("yr >= 1999"))
    return selection.forecast_report(out, KEYS)["predictions"].withColumn("predicted", F.col("prediction").isNotNull()).drop("prediction")


@query("hist_boosted_forecast")
def _(t):
    train, test = _parts(t)
    return _metrics(forecast.hist_boosted_forecast(train, test, "sales_lag1", FEATURES))


@query("hist_boosted_forecast_by_quarter", f"""
WITH {_LED}, means AS (SELECT qtr, avg(y) AS p FROM m WHERE yr < 2000 GROUP BY qtr)
SELECT CASE WHEN yr < 2000 THEN 'train' ELSE 'test' END AS part, {_SCORES}
FROM m JOIN means USING (qtr) WHERE y IS NOT NULL GROUP BY 1""", "fx_panel")
def _(t):
    """The quarter alone: the forecast is the mean of each."""
    train, test = _parts(t)
    return _scores(forecast.hist_boosted_forecast(train, test, "sales_lag1", ["qtr"]).metrics())


@query("expanding_backtest")
def _(t):
    rows = forecast.expanding_backtest(model_frame(t), "sales_lag1", FEATURES, "yr", 1999, 2001)
    return rounded(regression_metrics(rows, "sales_lag1", "pred_sales_lag1", ["yr"]), "rmse", "r2")


@query("expanding_backtest_by_quarter", f"""
WITH {_LED}, years AS (SELECT 1999 + i AS yr FROM range(0, 3) AS r(i)),
means AS (SELECT CAST(years.yr AS INT) AS yr, qtr, avg(y) AS p FROM m JOIN years ON m.yr < years.yr GROUP BY 1, 2)
SELECT yr, {_SCORES} FROM m JOIN means USING (yr, qtr) WHERE y IS NOT NULL GROUP BY yr""", "fx_panel")
def _(t):
    rows = forecast.expanding_backtest(model_frame(t), "sales_lag1", ["qtr"], "yr", 1999, 2001)
    return _scores(regression_metrics(rows, "sales_lag1", "pred_sales_lag1", ["yr"]))


@query("time_series_split", """
WITH r AS (SELECT entity, yr, qtr, row_number() OVER (ORDER BY yr, qtr, entity) - 1 AS i, count(*) OVER () AS n,
                  count(*) OVER () // 4 AS size FROM fx_panel)
SELECT entity, yr, qtr, CAST(CASE WHEN i < n - 3 * size THEN -1 ELSE (i - (n - 3 * size)) // size END AS INT) AS fold
FROM r""", "fx_panel")
def _(t):
    return folds.time_series_split(t.fx_panel.select(*KEYS), ORDER, 3)


@query("time_series_split_rows", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice,
  row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) - 1 AS i,
  count(*) OVER () AS n, count(*) OVER () // 6 AS size FROM lineitem)
SELECT fold, CAST(count(*) AS BIGINT) AS n_rows, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key,
       CAST(sum(l_quantity) AS DOUBLE) AS qty
FROM (SELECT *, CAST(CASE WHEN i < n - 5 * size THEN -1 ELSE (i - (n - 5 * size)) // size END AS INT) AS fold FROM r) AS x
GROUP BY fold""")
def _(t):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]
    split = folds.time_series_split(t.lineitem.select(*order), order, 5)
    return split.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.min("l_orderkey").alias("first_key"),
                                     F.max("l_orderkey").alias("last_key"), F.sum("l_quantity").alias("qty"))


@query("grid_search_forest")
def _(t):
    train, test = _parts(t)
    best, fit, table = forecast.grid_search_forest(train, test, "sales_lag1", FEATURES, ORDER)
    return _with_refit(table, F.col("setting") == best, fit)


@query("grid_search_boosted")
def _(t):
    train, test = _parts(t)
    best, fit, table = forecast.grid_search_boosted(train, test, "sales_lag1", FEATURES, ORDER)
    return _with_refit(table, F.col("setting") == best, fit)


@query("boosted_cv_rounds")
def _(t):
    train, test = _parts(t)
    best, fit, table = forecast.boosted_cv_rounds(train, test, "sales_lag1", FEATURES, KEYS,
                                                  settings=forecast.Booster(rounds=forecast.SEARCH_ROUNDS, learning_rate=0.1))
    return _with_refit(table, F.col("rounds") == best, fit)


@query("time_series_cv_score")
def _(t):
    train, test = _parts(t)
    scores, _ = forecast.time_series_cv_score(train, test, "sales_lag1", FEATURES, ORDER)
    return rounded(scores, "rmse", "r2")


@query("time_series_cv_score_by_quarter", f"""
WITH {_LED},
placed AS (SELECT *, row_number() OVER (ORDER BY yr, qtr, entity) - 1 AS i, count(*) OVER () AS n, count(*) OVER () // 4 AS size
           FROM m WHERE yr < 2000 AND y IS NOT NULL),
folds AS (SELECT *, CASE WHEN i < n - 3 * size THEN -1 ELSE (i - (n - 3 * size)) // size END AS fold FROM placed),
means AS (SELECT t.fold, f.qtr, avg(f.y) AS p FROM folds f JOIN (SELECT DISTINCT fold FROM folds WHERE fold >= 0) t ON f.fold < t.fold GROUP BY 1, 2),
scored AS (SELECT CAST(CAST(fold AS INT) AS VARCHAR) AS fold, count(*) AS n, sqrt(sum((y - p) * (y - p)) / count(*)) AS rmse,
             1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM folds JOIN means USING (fold, qtr) GROUP BY 1),
every AS (SELECT * FROM scored UNION ALL SELECT 'mean', CAST(sum(n) AS BIGINT), avg(rmse), avg(r2) FROM scored)
SELECT fold, n, round(rmse, 4) AS rmse, round(r2, 6) AS r2 FROM every""", "fx_panel")
def _(t):
    train, test = _parts(t)
    scores, _ = forecast.time_series_cv_score(train, test, "sales_lag1", ["qtr"], ORDER, settings=forecast.BACKTEST_DEFAULTS)
    return _scores(scores)


@query("forward_select_lasso")
def _(t):
    train, _ = _parts(t)
    feats = ["qtr", "sales", "qty", "sales_rolling_avg_3", "qty_rolling_avg_3", "seq"]
    chosen = selection.forward_select_lasso(train, "sales_lag1", feats, 3, ORDER)
    return t.spark.createDataFrame([(c,) for c in chosen], "feature string")
