"""Date and fiscal-period expressions. A text that does not parse gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterdeck.panel import column


def parse_date(c: str | Column, fmt: str) -> Column:
    """Text (or a number of digits) to DATE.

    ``fmt`` is a Spark pattern, or ``'year-week'`` for a year followed by a week
    number whose weeks begin on Monday. Month formats give the first of the month.
    """
    text = F.trim(column(c).cast("string"))
    if fmt == "year-week":
        return week_monday(F.regexp_extract(text, r"^(\d{4})(\d{1,2})$", 1),
                           F.regexp_extract(text, r"^(\d{4})(\d{1,2})$", 2))
    if fmt == "yyyyMM":
        # a one-digit month is allowed: 20131 and 201301 are the same month
        padded = F.regexp_replace(text, r"^(\d{4})(\d)$", "$10$2")
        return F.try_to_date(padded, "yyyyMM")
    if fmt == "MMM-yy":
        # two-digit years above 68 belong to the previous century
        d = F.try_to_date(text, "MMM-yy")
        return F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d)
    return F.try_to_date(text, fmt)


def week_monday(year: Column, week: Column) -> Column:
    """Monday of a week, where week 1 starts at the year's first Monday.

    Week 0 is the Monday before that and may lie in the previous year.
    """
    y, w = year.try_cast("int"), week.try_cast("int")
    first_monday = F.next_day(F.date_sub(F.make_date(y, F.lit(1), F.lit(1)), 1), "MON")
    monday = F.date_add(first_monday, 7 * (w - 1))
    return F.when(w.between(0, 53), monday)


def to_month(c: str | Column) -> Column:
    """Calendar month of a date or timestamp, as the first day of the month."""
    return F.trunc(column(c).cast("date"), "month")


def month_of(year: str | Column, month: str | Column) -> Column:
    """Month from separate year and month numbers."""
    return F.try_to_date(
        F.format_string("%d-%d", column(year).cast("int"), column(month).cast("int")), "yyyy-M")


# What marks a label of each kind, and where its year and quarter stand.
PERIOD_MARKS = {"annual": " A", "quarter": " Q", "estimate": "FQ"}
PERIOD_PATTERNS = {
    "annual": {"year": r"(\d{4})", "quarter": None},
    "quarter": {"year": r"(\d{4})", "quarter": r"Q(\d)"},
    "estimate": {"year": r"FQ\d+ (\d{4})", "quarter": r"FQ(\d+) \d{4}"},
}


def is_period(label: Column, kind: str) -> Column:
    """Whether a label is of the kind: an annual one ends in its mark."""
    mark = PERIOD_MARKS[kind]
    return label.endswith(mark) if kind == "annual" else label.contains(mark)


def period_part(label: Column, pattern: str) -> Column:
    """The first group of ``pattern`` as INT, null where it does not occur."""
    return F.nullif(F.regexp_extract(label, pattern, 1), F.lit("")).try_cast("int")
