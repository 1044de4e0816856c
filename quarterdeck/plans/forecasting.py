"""The closing job: join features and targets, drop outliers, select, forecast, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quarterdeck.operators.clean import drop_rows_containing
from quarterdeck.operators.forecast import Booster
from quarterdeck.operators.joins import join_on_period
from quarterdeck.operators.selection import forecast_report, forecast_targets
from quarterdeck.panel import column
from quarterdeck.session import pin


def select_and_forecast(frames: dict[str, DataFrame], keys: Sequence[str], targets: Sequence[str],
                        features: Sequence[str], *, categorical: Sequence[str] = (), chain: Sequence[str] = (),
                        outlier: str | None = None, lead: str = "_lag1", ranking: Booster | None = None,
                        settings: Booster = Booster(), first: int = 10, step: int = 5,
                        validation_from: int | None = None, year: str = "yr") -> dict[str, DataFrame]:
    """From the four imputed frames to predictions, quarterly R2 and a summary.

    ``outlier`` names the column whose training maximum marks rows to drop, in
    the training and the test part alike. Both parts are written once before the
    many fits that read them. With ``validation_from`` the training rows of that year and later are held
    back: feature counts are chosen on them, and the test rows are only scored.
    """
    train = join_on_period(frames["train_x"], frames["train_y"], list(keys))
    test = join_on_period(frames["test_x"], frames["test_y"], list(keys))
    if outlier:
        source = pin(frames["train_x"], "train")
        train, test = (drop_rows_containing(part, source, outlier) for part in (train, test))
    train, test, validation = pin(train, "train"), pin(test, "test"), None
    if validation_from is not None:
        train, validation = train.where(column(year) < validation_from), train.where(column(year) >= validation_from)
    chosen = forecast_targets(train, test, targets, features, categorical, chain, lead, ranking, settings, first, step, validation)
    return forecast_report(chosen, list(keys))
