"""Saturday-to-Friday survey weeks, lenient dates and day differences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHEET_EPOCH = "1899-12-30"


def week_start(ts: Column) -> Column:
    """The Saturday on or before a date or timestamp; null stays null."""
    day = F.to_date(ts)
    return F.date_sub(day, F.dayofweek(day) % 7)


def week_end(ts: Column) -> Column:
    """The Friday that ends the week of ``ts``."""
    return F.date_add(week_start(ts), 6)


def previous_week(ts: Column) -> Column:
    """Start of the week before that of ``ts``."""
    return F.date_sub(week_start(ts), 7)


def preceding_range(ts: Column) -> tuple[Column, Column]:
    """First and last day of the week before that of ``ts``: [start - 7 days, start - 1 day]."""
    return previous_week(ts), F.date_sub(week_start(ts), 1)


def saturdays(span: DataFrame, first: str, last: str, name: str = "week_start") -> DataFrame:
    """One row for each Saturday from that of ``first`` to that of ``last``, for each row of ``span``; none where either is null."""
    weeks = F.sequence(week_start(F.col(first)), week_start(F.col(last)), F.expr("interval 7 days"))
    return span.select(F.explode(F.when(F.col(first) <= F.col(last), weeks)).alias(name))


def next_saturday(day: Column) -> Column:
    """The first Saturday after ``day``, never ``day`` itself."""
    return F.next_day(F.to_date(day), "SAT")


def lenient_timestamp(text: Column, *formats: str) -> Column:
    """The text as a timestamp by the first format that fits, else by the usual ISO forms; null where none does."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats), F.try_to_timestamp(F.trim(text)))


def any_date(text: Column) -> Column:
    """A date from ISO text, month/day/year, or a spreadsheet's day number (days since 1899-12-30); null for anything else."""
    clean = F.trim(text)
    number = F.floor(F.when(clean.rlike(r"^\d{1,6}(\.\d*)?$"), clean).try_cast("double")).cast("int")
    serial = F.date_add(F.to_date(F.lit(SHEET_EPOCH)), number)
    day = lambda pattern, form: F.when(clean.rlike(pattern), F.to_date(F.try_to_timestamp(clean, F.lit(form))))
    return F.coalesce(day(r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"), day(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"), serial)


def whole_days(start: Column, end: Column) -> Column:
    """Full days from ``start`` to ``end``, rounded down, so minus one second is minus one day."""
    return F.floor((_micros(end) - _micros(start)) / F.lit(86_400_000_000)).cast("bigint")


def fractional_days(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end`` with their fraction."""
    return (_micros(end) - _micros(start)) / F.lit(86_400_000_000.0)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)
