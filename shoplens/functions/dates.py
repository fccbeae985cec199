"""Calendar expressions. All work on ``timestamp_ntz`` values, so no time zone takes part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("month", "quarter", "year")


def months_before(moment: Column, months: int) -> Column:
    """The date ``months`` months earlier; a day the month lacks runs over into the next month.

    31 May minus three months is 3 March, not 28 February.
    """
    day = F.to_date(moment)
    first_of_month = F.add_months(F.trunc(day, "MM"), -months)
    return F.date_add(first_of_month, F.dayofmonth(day) - 1).cast("timestamp_ntz")


def start_of_day_after(moment: Column, days: int) -> Column:
    """Midnight ``days`` days after the day of ``moment``."""
    return F.date_add(F.to_date(moment), days).cast("timestamp_ntz")


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour days from start to end, truncated toward zero."""
    return F.extract(F.lit("DAY"), end - start).cast("bigint")


def floor_days(start: Column, end: Column) -> Column:
    """Full days from start to end, rounded down, so half a day early is -1."""
    gap = end - start
    full = F.extract(F.lit("DAY"), gap)
    short = gap < F.make_dt_interval(full)
    return (full - F.when(short, 1).otherwise(0)).cast("bigint")


def require_period(period: str) -> None:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}; got {period!r}")


def period_label(moment: Column, period: str) -> Column:
    """Text label of a calendar period (``yyyy-MM``, ``yyyyQn`` or ``yyyy``); sorts by time."""
    require_period(period)
    year = F.date_format(moment, "yyyy")
    if period == "month":
        return F.date_format(moment, "yyyy-MM")
    if period == "quarter":
        return F.concat(year, F.lit("Q"), F.quarter(moment).cast("string"))
    return year


def period_start(moment: Column, period: str) -> Column:
    """First day of the calendar period that holds ``moment``."""
    require_period(period)
    return F.trunc(F.to_date(moment), period)
