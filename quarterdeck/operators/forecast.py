"""Boosted-tree and forest forecasts of a panel with Spark ML.

Missing features stay informative: a null becomes a value below all others, so a
tree can split it off. Rows whose target is null are not trained on, and not
scored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.operators.aggregate import regression_metrics
from quarterdeck.operators.folds import shuffled_folds, time_series_split
from quarterdeck.panel import column
from quarterdeck.session import pin

#: Fits of a search that run at a time: one alone leaves most of a cluster idle between its small jobs.
FITS_AT_ONCE = 4

#: Rows that are worth a task of their own: a fit passes over its rows hundreds of times, each time as long as its slowest task.
TASK_ROWS = 10_000

# What a null feature becomes, and the default learner settings.
MISSING = -1e18
LEARNING_RATE, FEATURE_FRACTION, BAGGING_FRACTION, SEED = 0.005, 0.9, 0.7, 42
RANKING_ROUNDS, FORECAST_ROUNDS = 20, 5


@dataclass(frozen=True)
class Booster:
    """Settings of the boosted trees. There is one setting for the rounds."""

    rounds: int = FORECAST_ROUNDS
    learning_rate: float = LEARNING_RATE
    feature_fraction: float = FEATURE_FRACTION
    bagging_fraction: float = BAGGING_FRACTION
    depth: int = 5
    bins: int = 32
    loss: str = "squared"
    seed: int = SEED

    def learner(self, label: str, weight: str | None = None) -> GBTRegressor:
        gbt = GBTRegressor(
            featuresCol="_features", labelCol=label, predictionCol=f"pred_{label}",
            maxIter=self.rounds, stepSize=self.learning_rate, subsamplingRate=self.bagging_fraction,
            featureSubsetStrategy=str(self.feature_fraction), maxDepth=self.depth, maxBins=self.bins,
            lossType=self.loss, seed=self.seed)
        return gbt.setWeightCol(weight) if weight else gbt


# What the histogram learner of the same family starts from when nothing is set.
HISTOGRAM_DEFAULTS = Booster(rounds=100, learning_rate=0.1, feature_fraction=1.0, bagging_fraction=1.0, bins=255)

# What the fold scores and the back-test start from.
CV_DEFAULTS = Booster(rounds=100, learning_rate=0.01, feature_fraction=0.8, bagging_fraction=0.8)
BACKTEST_DEFAULTS = Booster(rounds=100, learning_rate=0.1, feature_fraction=1.0, bagging_fraction=1.0)


def _stages(features: Sequence[str], categorical: Sequence[str]) -> list:
    stages = []
    inputs = [f"_n_{f}" for f in features if f not in categorical]
    if categorical:
        used = [c for c in categorical if c in features]
        stages.append(StringIndexer(inputCols=[f"_n_{c}" for c in used],
                                    outputCols=[f"_i_{c}" for c in used], handleInvalid="keep"))
        inputs += [f"_i_{c}" for c in used]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="_features")]


def _ready(df: DataFrame, features: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Working copies of the features without nulls."""
    return df.withColumns({
        f"_n_{f}": F.coalesce(column(f).cast("string"), F.lit("")) if f in categorical
        else F.coalesce(column(f).cast("double"), F.lit(MISSING)) for f in features})


def _spread(df: DataFrame) -> DataFrame:
    """``df`` in equal parts on all cores. What one task's rows are stays as it is, and so does what is drawn from them."""
    parts = min(df.sparkSession.sparkContext.defaultParallelism, df.count() // TASK_ROWS)
    return df.repartition(parts) if parts > 1 else df


def _cleared(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_n_", "_i_")) or c == "_features"])


@dataclass
class Forecast:
    """A fitted model with the frames it scored: ``pred_<label>`` is added to both."""

    model: PipelineModel
    label: str
    features: list[str]
    train: DataFrame
    test: DataFrame
    categorical: tuple[str, ...] = ()

    def score(self, part: DataFrame) -> DataFrame:
        """``part`` with the predictions of the model."""
        return _cleared(self.model.transform(_ready(part, self.features, self.categorical)))

    def metrics(self) -> DataFrame:
        """Rows, RMSE and R2 of the training and the test rows."""
        pred = f"pred_{self.label}"
        return regression_metrics(self.train, self.label, pred).withColumn("part", F.lit("train")) \
            .unionByName(regression_metrics(self.test, self.label, pred).withColumn("part", F.lit("test")))

    def rmse(self) -> float:
        return regression_metrics(self.test, self.label, f"pred_{self.label}").first()["rmse"]


def _fit(learner, train: DataFrame, test: DataFrame, label: str, features: Sequence[str],
         categorical: Sequence[str] = ()) -> Forecast:
    cats = [c for c in categorical if c in features]
    rows = _ready(train, features, cats)
    known = rows.where(column(label).isNotNull()).withColumn(label, column(label).cast("double"))
    front = Pipeline(stages=_stages(features, cats)).fit(known)
    if cats:
        # a split may send any subset of a category's labels one way, so all must have a bin
        most = max(len(labels) for labels in front.stages[0].labelsArray) + 1
        learner = learner.copy({learner.maxBins: max(learner.getMaxBins(), most)})
    # the learner reads these two columns, and a weight
    weight = [learner.getWeightCol()] if learner.isSet("weightCol") else []
    wide = _spread(front.transform(known).select(column(label), "_features", *weight))
    model = PipelineModel(stages=[*front.stages, learner.fit(wide)])
    fit = Forecast(model, label, list(features), train, test, tuple(cats))
    fit.train, fit.test = fit.score(train), fit.score(test)
    return fit


def boosted_forecast(train: DataFrame, test: DataFrame, label: str, features: Sequence[str],
                     categorical: Sequence[str] = (), settings: Booster = Booster()) -> Forecast:
    """Gradient boosting fitted to the training rows, scored on both parts."""
    return _fit(settings.learner(label), train, test, label, features, categorical)


def hist_boosted_forecast(train: DataFrame, test: DataFrame, label: str, features: Sequence[str],
                          settings: Booster = HISTOGRAM_DEFAULTS) -> Forecast:
    """The same with the default settings of a histogram learner."""
    return boosted_forecast(train, test, label, features, (), settings)


def rank_features(train: DataFrame, label: str, features: Sequence[str], categorical: Sequence[str] = (),
                  settings: Booster = Booster(rounds=RANKING_ROUNDS, loss="absolute")) -> DataFrame:
    """Features by their share of the gain, as rows (feature, importance).

    Rows weigh 1 / max(1, |target|), so the absolute loss counts relative errors.
    Leave the target's present value out of ``features``.
    """
    cats = [c for c in categorical if c in features]
    weighed = train.withColumn("_weight", 1 / F.greatest(F.lit(1.0), F.abs(column(label))))
    fit = _fit(settings.learner(label, "_weight"), weighed, weighed.limit(0), label, features, cats)
    names = [f for f in features if f not in cats] + cats
    gains = fit.model.stages[-1].featureImportances.toArray().tolist()
    rows = [(n, float(g)) for n, g in zip(names, gains)]
    return (train.sparkSession.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature"))


def expanding_backtest(df: DataFrame, label: str, features: Sequence[str], year: str, first: int,
                       last: int, include_last: bool = True, categorical: Sequence[str] = (),
                       settings: Booster = BACKTEST_DEFAULTS) -> DataFrame:
    """Predict each year from a model of all earlier years; the rows with truth.

    ``include_last=False`` stops before the last year. The models of different years are fitted side by side.
    """
    def forecast(y: int) -> DataFrame:
        fit = boosted_forecast(df.where(column(year) < y), df.where(column(year) == y), label, features, categorical, settings)
        return fit.test.where(column(label).isNotNull())

    parts = at_once([lambda y=y: forecast(y) for y in range(first, last + 1 if include_last else last)])
    return reduce(DataFrame.unionByName, parts) if parts else None


def at_once(jobs: Sequence[Callable], limit: int = FITS_AT_ONCE) -> list:
    """The results of the jobs in their order; up to ``limit`` of them wait for Spark at a time."""
    with ThreadPoolExecutor(limit) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def _assembled(folds: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """fold, label and the features as one vector, written once and read by every fit."""
    ready = _spread(_ready(folds.where(column(label).isNotNull()), features, ()))
    wide = _stages(features, ())[0].transform(ready)
    return pin(wide.select("fold", column(label).cast("double").alias(label), "_features"), "folds")


def grid_search(train: DataFrame, test: DataFrame, label: str, features: Sequence[str], order: list[str],
                grid: dict[str, object], n_splits: int) -> tuple[str, Forecast, DataFrame]:
    """Try every learner of ``grid`` on expanding folds and refit the best.

    Returns its name, its forecast, and the scores as rows (setting, mse). The features are assembled once, and
    fits of different folds and settings run side by side.
    """
    folds = _assembled(time_series_split(train.where(column(label).isNotNull()), order, n_splits), label, features)
    error = F.pow(column(label) - column(f"pred_{label}"), F.lit(2.0))

    def squared_error(make, fold):
        model = make().fit(folds.where(F.col("fold") < fold))
        return model.transform(folds.where(F.col("fold") == fold)).agg(F.avg(error)).first()[0]

    tried = [(name, fold) for name in grid for fold in range(n_splits)]
    errors = at_once([lambda name=name, fold=fold: squared_error(grid[name], fold) for name, fold in tried])
    scores = {name: sum(e for (n, _), e in zip(tried, errors, strict=True) if n == name) / n_splits for name in grid}
    best = min(scores, key=scores.get)
    table = train.sparkSession.createDataFrame(list(scores.items()), "setting string, mse double")
    return best, _fit(grid[best](), train, test, label, features), table


# The settings tried by default.
FOREST_TREES = (50, 100, 200, 300, 500)
FRACTIONS = (0.7, 0.8, 0.9)
SEARCH_ROUNDS = 1500


def grid_search_forest(train: DataFrame, test: DataFrame, label: str, features: Sequence[str],
                       order: list[str], trees: Sequence[int] = FOREST_TREES, n_splits: int = 2,
                       seed: int = SEED):
    """Random forests over the number of trees."""
    def forest(n):
        return lambda: RandomForestRegressor(featuresCol="_features", labelCol=label,
                                             predictionCol=f"pred_{label}", numTrees=n, seed=seed)
    return grid_search(train, test, label, features, order, {f"trees={n}": forest(n) for n in trees}, n_splits)


def grid_search_boosted(train: DataFrame, test: DataFrame, label: str, features: Sequence[str],
                        order: list[str], feature_fractions: Sequence[float] = FRACTIONS,
                        bagging_fractions: Sequence[float] = FRACTIONS, n_splits: int = 3,
                        rounds: int = SEARCH_ROUNDS):
    """Boosted trees over the shares of features and rows used."""
    def booster(f, b):
        settings = Booster(rounds=rounds, feature_fraction=f, bagging_fraction=b)
        return lambda: settings.learner(label)
    grid = {f"features={f},rows={b}": booster(f, b) for f in feature_fractions for b in bagging_fractions}
    return grid_search(train, test, label, features, order, grid, n_splits)


def _stop(curve: Sequence[float], patience: int) -> tuple[int, bool]:
    """The place of the least error before it fails to improve ``patience`` times, and whether it came to that."""
    best = 0
    for i, error in enumerate(curve):
        if error < curve[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def boosted_cv_rounds(train: DataFrame, test: DataFrame, label: str, features: Sequence[str], keys: list[str],
                      n_folds: int = 5, patience: int = 50,
                      settings: Booster = Booster(rounds=SEARCH_ROUNDS)) -> tuple[int, Forecast, DataFrame]:
    """Choose the number of rounds by cross-validation over shuffled folds, then refit.

    One model per fold is scored after each of its rounds. The rounds kept are
    those with the least mean error before it fails to improve ``patience`` times. Fitting stops early: models of
    2 * ``patience`` rounds are fitted first, side by side, and twice as many as long as the error hasn't stopped
    improving. A model's first rounds are the same however many follow, so the choice is that of the full
    ``settings.rounds``, for at most four times the rounds needed. The table holds (rounds, mse, fitted): the curve up to where
    it stopped, and how many rounds the last models had.
    """
    folds = _assembled(shuffled_folds(train.where(column(label).isNotNull()), keys, n_folds), label, features)

    def curve(fold: int, rounds: int) -> list[float]:
        model = replace(settings, rounds=rounds).learner(label).fit(folds.where(F.col("fold") != fold))
        return model.evaluateEachIteration(folds.where(F.col("fold") == fold), "squared")

    fitted = min(settings.rounds, 2 * patience)
    while True:
        curves = at_once([lambda fold=fold: curve(fold, fitted) for fold in range(n_folds)])
        mean = [sum(errors) / n_folds for errors in zip(*curves, strict=True)]
        best, stopped = _stop(mean, patience)
        if stopped or fitted == settings.rounds:
            break
        fitted = min(settings.rounds, 2 * fitted)
    read = mean[:best + patience + 1] if stopped else mean
    table = train.sparkSession.createDataFrame([(i + 1, e, fitted) for i, e in enumerate(read)], "rounds int, mse double, fitted int")
    return best + 1, boosted_forecast(train, test, label, features, (), replace(settings, rounds=best + 1)), table


def time_series_cv_score(train: DataFrame, test: DataFrame, label: str, features: Sequence[str],
                         order: list[str], n_splits: int = 3,
                         settings: Booster = CV_DEFAULTS) -> tuple[DataFrame, Forecast]:
    """RMSE and R2 of each expanding fold and their mean, and a fit to all training rows; all fits run side by side."""
    folds = time_series_split(train.where(column(label).isNotNull()), order, n_splits)

    def fitted(fold: int) -> Forecast:
        return boosted_forecast(folds.where(F.col("fold") < fold), folds.where(F.col("fold") == fold), label, features, (), settings)

    *fits, final = at_once([*[lambda f=f: fitted(f) for f in range(n_splits)],
                            lambda: boosted_forecast(train, test, label, features, (), settings)])
    scored = reduce(DataFrame.unionByName, [regression_metrics(fit.test, label, f"pred_{label}").withColumn("fold", F.lit(str(f)))
                                            for f, fit in enumerate(fits)])
    mean = scored.agg(F.sum("n").alias("n"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"),
                      F.lit("mean").alias("fold"))
    return scored.unionByName(mean), final
