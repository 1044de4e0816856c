"""The registered model queries run on all features with the operators' own settings."""

import inspect

import pytest

from quarterdeck.operators import forecast, selection
from quarterdeck.plans import forecasting
from registry.book import ORACLES, QUERIES
from registry.models import FEATURES
from tests.conftest import DATA

FULL = ["hist_boosted_forecast", "expanding_backtest", "time_series_cv_score"]


class Called(Exception):
    pass


def _arguments(name, module, function, spark, monkeypatch):
    """What the query passes to the function, which then isn't run."""
    shape = inspect.signature(getattr(module, function))

    def told(*args, **kwargs):
        raise Called(shape.bind(*args, **kwargs).arguments)

    monkeypatch.setattr(module, function, told)
    with pytest.raises(Called) as called:
        QUERIES[name](spark, DATA)
    return called.value.args[0]


@pytest.mark.parametrize("name", FULL)
def test_all_features_and_default_settings(name, spark, monkeypatch):
    given = _arguments(name, forecast, name, spark, monkeypatch)
    assert given["features"] == FEATURES and not {"settings", "n_splits"} & set(given)
    assert f"{name}_by_quarter" in ORACLES


DEFAULTS = {"rank_features": (forecast, "rank_features"), "search_feature_count": (selection, "search_feature_count"),
            "forecast_targets": (selection, "forecast_targets"), "forecast_report": (selection, "forecast_targets"),
            "select_and_forecast": (forecasting, "select_and_forecast"), "grid_search_forest": (forecast, "grid_search_forest")}


@pytest.mark.parametrize("name", DEFAULTS)
def test_default_rounds_and_counts(name, spark, monkeypatch):
    given = _arguments(name, *DEFAULTS[name], spark, monkeypatch)
    assert not {"settings", "ranking", "first", "step", "trees", "n_splits"} & set(given)


def test_rounds_are_searched_with_default_folds_and_patience(spark, monkeypatch):
    given = _arguments("boosted_cv_rounds", forecast, "boosted_cv_rounds", spark, monkeypatch)
    assert not {"n_folds", "patience"} & set(given) and given["settings"].rounds == forecast.SEARCH_ROUNDS


def test_the_boosted_grid_is_searched_with_all_rounds(spark, monkeypatch):
    rounds = inspect.signature(forecast.grid_search_boosted).parameters["rounds"].default
    given = _arguments("grid_search_boosted", forecast, "grid_search_boosted", spark, monkeypatch)
    assert given["features"] == FEATURES and not {"rounds", "feature_fractions", "bagging_fractions", "n_splits"} & set(given)
    assert rounds == 1500


@pytest.mark.parametrize("name", ["forecast_report", "forecast_targets"])
def test_targets_are_ranked_and_forecast_with_all_rounds(name, spark, monkeypatch):
    ranked, searched = [], []

    def rank(train, label, features, categorical=(), settings=None):
        ranked.append(settings.rounds)
        return spark.createDataFrame([(f,) for f in features], "feature string")

    def search(train, test, label, current, order, categorical=(), settings=None, *args):
        searched.append(settings.rounds)
        raise Called

    monkeypatch.setattr(selection, "rank_features", rank)
    monkeypatch.setattr(selection, "search_feature_count", search)
    with pytest.raises(Called):
        QUERIES[name](spark, DATA)
    assert set(ranked) == {1000} and set(searched) == {1500}
