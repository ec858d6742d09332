"""Time arithmetic on timestamps without zone, to the microsecond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.242


def micros_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def seconds_between(later: Column, earlier: Column) -> Column:
    return micros_between(later, earlier).cast("double") / 1e6


def days_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / 60.0 / 60.0 / 24.0


def years_between(later: Column, earlier: Column) -> Column:
    return days_between(later, earlier) / DAYS_PER_YEAR


def date_years_between(later: Column, earlier: Column) -> Column:
    """Years between the calendar dates, to two places."""
    return F.round(F.datediff(F.to_date(later), F.to_date(earlier)) / DAYS_PER_YEAR, 2)


def hours(n: int) -> Column:
    return F.expr(f"interval '{n}' hour")


def days(n: int) -> Column:
    return F.expr(f"interval '{n}' day")


def years(n: int) -> Column:
    return F.expr(f"interval '{n}' year")
