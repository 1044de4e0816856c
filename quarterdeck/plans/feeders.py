"""Jobs that turn raw outside series into monthly, daily or quarterly features.

After the aggregation to months (or days) a series has one row per calendar
period, so the ordered windows here run over a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.dates import month_of, parse_date, period_part, week_monday, PERIOD_PATTERNS
from quarterdeck.functions.numeric import parse_numeric_text
from quarterdeck.operators.aggregate import monthly_mean
from quarterdeck.operators.clean import drop_annual_totals, drop_null_rows, sentinels_to_null
from quarterdeck.operators.joins import outer_join_series, right_join_series
from quarterdeck.operators.reshape import pivot_series, transpose_series, union_rows, unpivot_years
from quarterdeck.operators.windows import add_lags, moving_average
from quarterdeck.panel import PanelSpec, column
from quarterdeck.sources.tables import sanitize_columns

MONTH = "year_month"
MONTHLY = PanelSpec.of((), (MONTH,))
ROLLING = "{col}_{n}_month_rolling_avg"


def _monthly_features(daily: DataFrame, date: str, lags: bool) -> DataFrame:
    named = sanitize_columns(daily)
    cols = [c for c in named.columns if c != date]
    monthly = monthly_mean(named, date, cols, MONTH)
    out = moving_average(monthly, MONTHLY, cols)
    return add_lags(out, MONTHLY, cols) if lags else out


def macro_monthly_features(*sheets: DataFrame, date: str = "Date") -> DataFrame:
    """Sheets of dated values: monthly means, moving averages and lags, side by side."""
    return outer_join_series(*[_monthly_features(s, date, True) for s in sheets], key=MONTH)


def refinery_monthly_features(utilization: DataFrame, net_input: DataFrame, gross_input: DataFrame,
                              capacity: DataFrame, date: str = "Date") -> DataFrame:
    """Four weekly series by month with moving averages, over the months of the net input.

    Every series is placed in months by its own dates.
    """
    u, n, g, c = (_monthly_features(s, date, False) for s in (utilization, net_input, gross_input, capacity))
    return right_join_series(u, n, g, c, key=MONTH)


def rig_count_features(weekly: DataFrame, monthly: DataFrame, years: dict[str, int], until: str,
                       week: str = "Weeks", value: str = "Rigs_Count") -> DataFrame:
    """Weekly counts with one column per year up to ``until``, monthly counts from then on.

    ``monthly`` holds ``Year``, ``Month`` and the count.
    """
    long = unpivot_years(weekly, [week], years, value, "Year")
    long = sentinels_to_null(long, numeric=(), text=(" ",), columns=[value])
    long = drop_null_rows(long.withColumn("Date", week_monday(F.col("Year"), column(week))), [value])
    long = long.withColumn(value, parse_numeric_text(value))
    early = monthly_mean(long, "Date", [value], MONTH).where(F.col(MONTH) < F.lit(until).cast("date"))
    late = monthly.select(month_of("Year", "Month").alias(MONTH), column(value).cast("double").alias(value))
    return moving_average(union_rows(late, early), MONTHLY, [value])


def energy_summary_features(wide: DataFrame, item: str, periods: list[str], names: dict[str, str]) -> DataFrame:
    """Items in rows and months such as ``Jan-97`` in columns: one row per month.

    Cells are text; ``--`` is missing. ``names`` maps items to column names.
    """
    rows = transpose_series(wide, item, periods, names, "month_label")
    cols = list(names.values())
    rows = sentinels_to_null(rows, numeric=(), text=("--",), columns=cols)
    rows = rows.select(parse_date("month_label", "MMM-yy").alias(MONTH),
                       *[parse_numeric_text(c).alias(c) for c in cols])
    return moving_average(rows, MONTHLY, cols, name=ROLLING)


def energy_long_features(long: DataFrame, names: dict[str, str], yyyymm: str = "YYYYMM",
                         key: str = "Description", value: str = "Value") -> DataFrame:
    """A (YYYYMM, description, value) table: one column per series, annual totals dropped."""
    wide = pivot_series(drop_annual_totals(long, yyyymm), [yyyymm], key, value, names)
    return moving_average(wide, PanelSpec.of((), (yyyymm,)), list(names.values()), name=ROLLING)


def prompt_month_features(daily: DataFrame, date: str = "Date") -> DataFrame:
    """Daily prices with their 60, 90 and 360 row averages.

    The input is not aggregated, so its rows are put in order over all tasks and averaged in blocks.
    """
    named = sanitize_columns(daily)
    cols = [c for c in named.columns if c != date]
    return moving_average(named, PanelSpec.of((), (date,), bounded=False), cols, (60, 90, 360), "{col}_{n}_Day_MA")


def analyst_estimates(sheets: dict[object, DataFrame], item: str, periods: list[str], names: dict[str, str],
                      entity: str = "entity", prefix: str = "s_p_estimate_") -> DataFrame:
    """One sheet per company, items in rows and labels such as ``FQ3 2000 - Sep 2000`` in columns.

    One row per company and quarter; cells such as ``1,234.5 E`` become numbers.
    """
    # one frame with a company column: the plan does not grow with the companies
    text = union_rows(*[sheet.select(F.lit(company).alias(entity), item, *[column(p).cast("string").alias(p) for p in periods])
                        for company, sheet in sheets.items()])
    return company_estimates(text, item, periods, names, entity, prefix)


def company_estimates(sheets: DataFrame, item: str, periods: list[str], names: dict[str, str],
                      entity: str = "entity", prefix: str = "s_p_estimate_") -> DataFrame:
    """The same from one frame that holds the sheets of all companies, told apart by ``entity``."""
    rows = transpose_series(sheets, item, periods, names, "label", [entity])
    rule = PERIOD_PATTERNS["estimate"]
    out = rows.select(entity, period_part(F.col("label"), rule["year"]).alias("Year"),
                      period_part(F.col("label"), rule["quarter"]).alias("Quarter"),
                      *[parse_numeric_text(c).alias(c) for c in names.values()])
    return sanitize_columns(out.dropna(subset=["Year", "Quarter"]), prefix)
