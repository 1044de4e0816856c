"""Jobs over the panel: clean, impute, enrich, industry statistics, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.operators.asof import asof_join, peer_features
from quarterdeck.operators.clean import (drop_max_outlier, drop_suffixed_values, filter_from, flip_sign, map_codes,
                                         parse_fiscal_period, sentinels_to_null)
from quarterdeck.operators.crosssection import group_statistics, period_total
from quarterdeck.operators.derive import dividend_estimate, scale_percent
from quarterdeck.operators.drift import population_stability_index
from quarterdeck.operators.impute import build_train_test
from quarterdeck.operators.joins import join_dimension, join_exact_date, join_month_series
from quarterdeck.operators.resolve import resolve_by_priority
from quarterdeck.operators.windows import add_lead_targets, add_year_ago, period_return
from quarterdeck.functions.dates import parse_date, to_month
from quarterdeck.panel import PanelSpec, column
from quarterdeck.session import pin
from quarterdeck.sources.tables import drop_suffixed_columns, sanitize_columns

QUARTERS = PanelSpec.of("entity", ("yr", "qtr"))


def clean_panel(filings: DataFrame, company: DataFrame, codes: DataFrame, *, label: str, targets: Sequence[str],
                measures: Sequence[str], announced: str, code_maps: dict[str, tuple[str, str]], code_order: str,
                updated: str, consolidated: str, status: str, standard: str, peers: dict[str, object],
                first_year: int = 1998, outlier: str | None = None, panel: PanelSpec = QUARTERS) -> DataFrame:
    """Filings to one row per entity and quarter with next-quarter targets.

    Periods are parsed, conflicting filings resolved, industry labels attached,
    targets added by lead and lag, sentinels removed, early years and the outlier
    dropped, and each named peer's last announced targets joined as of the row's
    next announcement.
    """
    (entity,) = panel.entity
    rows = parse_fiscal_period(drop_suffixed_columns(filings), label, "quarter")
    values = [*dict.fromkeys([*targets, *measures, announced])]
    resolved = resolve_by_priority(rows, [entity, "yr", "qtr"], values, updated, consolidated, status, standard)
    led = add_lead_targets(resolved, panel, [*targets, announced, "yr", "qtr"])
    led = add_year_ago(led, panel, list(targets))
    led = sentinels_to_null(led, text=("NULL",), columns=[c for c in led.columns if c not in (entity, "yr", "qtr")])
    # the panel is read by the outlier's maximum and by both sides of the peer join: settle it once
    kept = pin(filter_from(led, "yr", first_year), "panel")
    if outlier:
        kept = drop_max_outlier(kept, outlier, [f"{outlier}_lag1"])
    led_targets = [f"{t}_lag1" for t in targets]
    out = peer_features(kept, peers, entity, f"{announced}_lag1", led_targets, tiebreak=["yr", "qtr"])
    labels = map_codes(company, codes, code_maps, code_order).select(entity, *[f"{c}_mapped" for c in code_maps])
    return join_dimension(out, labels, entity)


def impute_train_test(panel_rows: DataFrame, features: Sequence[str], targets: Sequence[str], *,
                      negative: Sequence[str] = (), cutoff: int = 2018, min_train: int = 3,
                      threshold: float = 0.8, panel: PanelSpec = QUARTERS) -> dict[str, DataFrame]:
    """The four frames of a forecast, imputed, with the sign of ``negative`` columns turned."""
    frames = build_train_test(panel_rows, panel, list(features), list(targets), cutoff=cutoff,
                              min_train=min_train, threshold=threshold)
    return {k: flip_sign(f, [c for c in negative if c in f.columns]) for k, f in frames.items()}


def enrich_panel(rows: DataFrame, *, period_end: str, market: DataFrame, market_date: str, index: str,
                 yield_percent: str, monthly: Sequence[DataFrame], daily: DataFrame, daily_date: str,
                 operations: DataFrame, operations_date: str, estimates: DataFrame, estimate_keys: dict[str, str],
                 dividend: dict, params: DataFrame, flip: Sequence[str] = (), trading_days: int = 252,
                 panel: PanelSpec = QUARTERS) -> DataFrame:
    """Attach every outside source to the panel.

    The last market row on or before the period end (index return and risk-free
    rate included), the dividend estimate, monthly series by month, daily series
    by date, company operations by date and entity, and estimates of the next
    quarter. Column names come out plain, and ``--`` as null.
    """
    (entity,) = panel.entity
    prices = period_return(market, PanelSpec.of((), (market_date,), bounded=False), index, trading_days, "index_return")
    prices = sentinels_to_null(scale_percent(prices, {yield_percent: "risk_free_rate"}), numeric=(), text=())
    out = asof_join(rows, prices, period_end, market_date,
                    [c for c in prices.columns if c != market_date], strict=False)
    out = dividend_estimate(out, panel, params, risk_free="risk_free_rate", market_return="index_return", **dividend)
    out = out.withColumn("year_month", to_month(period_end))
    out = join_month_series(out, "year_month", *monthly)
    out = join_exact_date(out, daily, {period_end: daily_date}, "_daily")
    dated = drop_suffixed_values(operations, operations_date)
    dated = dated.withColumn(operations_date, parse_date(operations_date, "dd/MM/yyyy"))
    dated = dated.withColumnRenamed(entity, "operations_entity")
    out = join_exact_date(out, dated, {period_end: operations_date, entity: "operations_entity"}, "_ops")
    out = join_exact_date(out, estimates, estimate_keys, "_estimate")
    out = flip_sign(out, list(flip))
    return sanitize_columns(sentinels_to_null(out, numeric=(), text=("--",), inf=False))


def industry_statistics(rows: DataFrame, features: Sequence[str], levels: Sequence[str],
                        targets: Sequence[str], period: Sequence[str] = ("yr", "qtr")) -> DataFrame:
    """Cross-section statistics per level, and the total of each target, on every row."""
    return period_total(group_statistics(rows, list(features), list(levels), list(period)), list(targets), list(period))


def drift_check(expected: DataFrame, actual: DataFrame, cols: Sequence[str], bins: int = 10,
                alert: float | None = None) -> DataFrame:
    """PSI per column, largest first; with ``alert`` a flag where it is reached."""
    out = population_stability_index(expected, actual, list(cols), bins)
    if alert is not None:
        out = out.withColumn("drifted", F.col("psi") >= alert)
    return out.orderBy(column("psi").desc(), "column")
