import itertools
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import folds, forecast, selection
from quarterdeck.operators.aggregate import regression_metrics
from registry.book import QUERIES
from tests.conftest import DATA

SMALL = forecast.Booster(rounds=2, learning_rate=0.3, depth=2)


@pytest.fixture(scope="module")
def frame(spark):
    rnd = np.random.default_rng(0)
    rows = []
    for e in range(20):
        for y in range(2010, 2020):
            a, b, noise = rnd.normal(), rnd.normal(), rnd.normal()
            target = 3 * a + 0.1 * noise
            rows.append((e, y, 1, float(a), None if rnd.random() < 0.2 else float(b), f"c{e % 4}",
                         None if rnd.random() < 0.1 else float(target)))
    return spark.createDataFrame(rows, "entity int, yr int, qtr int, a double, b double, c string, y_lag1 double").cache()


def _parts(frame):
    return frame.where("yr < 2018"), frame.where("yr >= 2018")


def test_the_informative_feature_ranks_first(frame):
    ranked = forecast.rank_features(frame, "y_lag1", ["b", "a", "c"], ["c"], forecast.Booster(rounds=3, depth=2, loss="absolute"))
    got = ranked.collect()
    assert got[0]["feature"] == "a" and {r["feature"] for r in got} == {"a", "b", "c"}


def test_forecast_scores_every_row_and_repeats(frame):
    train, test = _parts(frame)
    one, two = (forecast.boosted_forecast(train, test, "y_lag1", ["a", "b", "c"], ["c"], SMALL) for _ in range(2))
    assert one.test.count() == test.count() and one.test.where("pred_y_lag1 is null").count() == 0
    a, b = (f.metrics().orderBy("part").collect() for f in (one, two))
    assert a == b and a[0]["n"] == test.where("y_lag1 is not null").count()
    again = regression_metrics(one.test, "y_lag1", "pred_y_lag1").first()
    assert again["rmse"] == a[0]["rmse"]


def test_test_rows_do_not_change_the_model(frame):
    train, test = _parts(frame)
    shifted = test.withColumn("y_lag1", F.col("y_lag1") + 1000)
    preds = [[r[0] for r in forecast.boosted_forecast(train, part, "y_lag1", ["a", "b"], (), SMALL).test
              .orderBy("entity", "yr").select("pred_y_lag1").collect()] for part in (test, shifted)]
    assert preds[0] == preds[1]


def test_backtest_years(frame):
    rows = lambda **k: {r["yr"] for r in forecast.expanding_backtest(frame, "y_lag1", ["a"], "yr", 2017, 2019, settings=SMALL, **k)
                        .select("yr").distinct().collect()}
    assert rows() == {2017, 2018, 2019} and rows(include_last=False) == {2017, 2018}


def test_expanding_folds(spark):
    df = spark.range(23).selectExpr("id", "id % 4 as k").repartition(5)
    got = [r["fold"] for r in folds.time_series_split(df, ["id"], 3).orderBy("id").collect()]
    assert got == [-1] * 8 + [0] * 5 + [1] * 5 + [2] * 5
    runs = [r["fold"] for r in folds.contiguous_folds(df, ["id"], 5).orderBy("id").collect()]
    assert runs == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4
    mixed = folds.shuffled_folds(df, ["id"], 3)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, folds.shuffled_folds(df.repartition(2), ["id"], 3).collect()))


def test_feature_count_search_on_known_curves():
    def tried(curve, total=40, first=10, step=5):
        return selection.search_count(lambda n: curve(n), total, first, step)
    # falls until 20, worse at 25: steps back from 24 and stops once worse below the best
    best, least, seen = tried(lambda n: abs(n - 20))
    assert (best, least) == (20, 0) and sorted(seen) == [10, 15, 19, 20, 21, 22, 23, 24, 25]
    # the best lies between two steps
    assert tried(lambda n: abs(n - 22))[0] == 22
    # equal errors prefer the smaller count, and one feature is never tried
    best, _, seen = tried(lambda n: 1.0)
    assert best == 2 and min(seen) == 2
    # counts above the number of features mean all of them
    assert tried(lambda n: -n, total=12)[0] == 12


def test_greedy_lasso_equals_refitting_on_the_rows(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(60, 4)) * [1, 2, 1, 3] + [0, 5, 1, 0]
    y = 2 * x[:, 1] - 1.5 * x[:, 3] + 0.3 * x[:, 0] + rnd.normal(size=60)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "i int, a double, b double, c double, d double, y double").repartition(4)

    def lasso(xs, ys, alpha=0.1):
        xm, ym = xs.mean(0), ys.mean()
        u, v, b = xs - xm, ys - ym, np.zeros(xs.shape[1])
        for _ in range(500):
            for j in range(len(b)):
                r = v - u @ b + u[:, j] * b[j]
                z = u[:, j] @ r / len(v)
                b[j] = np.sign(z) * max(abs(z) - alpha, 0) / (u[:, j] @ u[:, j] / len(v))
        return lambda q: (q - xm) @ b + ym

    chosen = []
    for _ in range(3):
        def score(j):
            idx, out = [*chosen, j], []
            for f in range(5):
                held = np.arange(60) // 12 == f
                p = lasso(x[~held][:, idx], y[~held])(x[held][:, idx])
                out.append(1 - ((y[held] - p) ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum())
            return np.mean(out)
        chosen.append(max((j for j in range(4) if j not in chosen), key=score))
    assert selection.forward_select_lasso(df, "y", names, 3, ["i"]) == [names[j] for j in sorted(chosen)]


RUN = ["search_feature_count", "grid_search_forest", "select_and_forecast"]
FULL = ["hist_boosted_forecast", "expanding_backtest", "time_series_cv_score"]
MODEL_QUERIES = ["rank_features", "search_feature_count", "forecast_targets", "boosted_forecast", "grid_search_forest",
                 "boosted_cv_rounds", "forward_select_lasso", "select_and_forecast", *FULL]


@pytest.mark.parametrize("name", RUN)
def test_registered_models_give_rows(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0


def test_searches_score_their_refit(spark):
    rows = QUERIES["boosted_cv_rounds"](spark, DATA).collect()
    chosen = [r for r in rows if r["chosen"]]
    assert len(chosen) == 1 and chosen[0]["mse"] == min(r["mse"] for r in rows)
    assert chosen[0]["test_rmse"] > 0 and chosen[0]["test_r2"] < 1
    assert all(r["test_rmse"] is None and r["test_r2"] is None for r in rows if not r["chosen"])


def test_fitting_stops_early_where_the_whole_curve_would(frame):
    train, test = frame.where("yr < 2017").withColumn("y", F.col("a")), frame.where("yr >= 2017").withColumn("y", F.col("a"))
    settings = forecast.Booster(rounds=24, depth=2, learning_rate=0.5)
    args = (train, test, "y_lag1", ["a", "b"], ["entity", "yr", "qtr"])
    _, _, whole = forecast.boosted_cv_rounds(*args, n_folds=2, patience=100, settings=settings)
    curve = [r["mse"] for r in whole.orderBy("rounds").collect()]
    assert len(curve) == 24
    best, stopped = forecast._stop(curve, 2)
    rounds, fit, early = forecast.boosted_cv_rounds(*args, n_folds=2, patience=2, settings=settings)
    found = early.orderBy("rounds").collect()
    assert rounds == best + 1 == fit.model.stages[-1].getNumTrees
    assert [r["mse"] for r in found] == pytest.approx(curve[:best + 3] if stopped else curve, rel=1e-9)
    assert len(found) <= found[0]["fitted"] <= 24


def test_fits_side_by_side_keep_their_order_and_errors():
    assert forecast.at_once([lambda i=i: i * i for i in range(20)]) == [i * i for i in range(20)]
    with pytest.raises(ZeroDivisionError):
        forecast.at_once([lambda: 1, lambda: 1 / 0])


def test_the_full_histogram_forecast_beats_the_mean_in_training(spark):
    parts = {r["part"]: r for r in QUERIES["hist_boosted_forecast"](spark, DATA).collect()}
    assert set(parts) == {"train", "test"} and all(r["n"] > 0 and r["rmse"] > 0 for r in parts.values())
    assert 0 < parts["train"]["r2"] <= 1


def test_every_query_is_named_once_and_has_a_text_or_a_test():
    from registry.book import ORACLES
    without = set(QUERIES) - set(ORACLES)
    assert without <= set(MODEL_QUERIES) | {"forecast_report", "grid_search_boosted"}
    assert not set(ORACLES) - set(QUERIES)
    assert len(list(itertools.chain(QUERIES))) > 100


def test_feature_counts_are_chosen_on_validation_rows(frame):
    train, held, test = frame.where("yr < 2016"), frame.where("yr IN (2016, 2017)"), frame.where("yr >= 2018")
    renamed = [p.withColumn("y", F.col("a") * 0) for p in (train, held, test)]
    out = selection.forecast_targets(renamed[0], renamed[2], ["y"], ["a", "b"], chain=["y"], ranking=forecast.Booster(rounds=2, depth=2, loss="absolute"),
                                     settings=SMALL, first=2, step=1, validation=renamed[1])
    fit = out["y"].forecast
    scored = regression_metrics(fit.score(renamed[1]), "y_lag1", "pred_y_lag1").first()["rmse"]
    assert out["y"].scores[out["y"].count] == pytest.approx(scored, rel=1e-9)
    assert fit.test.count() == test.count()


def test_rows_of_a_fit_are_dealt_out_evenly_where_they_are_many(spark, monkeypatch):
    df = spark.range(0, 4000, 1, 3).where("id < 1400").selectExpr("id")
    assert forecast._spread(df).rdd.getNumPartitions() == 3
    monkeypatch.setattr(forecast, "TASK_ROWS", 200)
    held = forecast._spread(df).rdd.glom().map(len).collect()
    assert sum(held) == 1400 and len(held) == 7 and max(held) - min(held) < 20


def test_years_of_a_backtest_are_fitted_side_by_side(rows, monkeypatch):
    at, lock, most = [0], threading.Lock(), [0]
    fit = forecast._fit

    def counted(*args, **kwargs):
        with lock:
            at[0] += 1
            most[0] = max(most[0], at[0])
        time.sleep(0.5)
        try:
            return fit(*args, **kwargs)
        finally:
            with lock:
                at[0] -= 1

    monkeypatch.setattr(forecast, "_fit", counted)
    df = rows("yr int, x double, y double", [(2000 + i % 4, float(i % 5), float(i % 5 * 3)) for i in range(80)])
    settings = forecast.Booster(rounds=2, learning_rate=0.5, depth=3, bagging_fraction=1.0, feature_fraction=1.0)
    got = forecast.expanding_backtest(df, "y", ["x"], "yr", 2001, 2003, settings=settings)
    assert most[0] == 3 and sorted(r["yr"] for r in got.select("yr").collect()) == sorted(2001 + i % 3 for i in range(60))
