"""Month and day bounds, for columns and for driver-side parameters."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(moment: Column, shift: int = 0) -> Column:
    """First day of the month, moved by whole months."""
    return F.add_months(F.trunc(moment, "month"), shift)


def day_of(moment: Column) -> Column:
    return moment.cast("date")


def month_bounds(year: int, month: int) -> tuple[datetime, datetime]:
    """Start of a month and of the next one, in UTC."""
    start = datetime(year, month, 1, tzinfo=timezone.utc)
    return start, begin_current_month(start + timedelta(days=32))


def begin_current_month(now: datetime) -> datetime:
    return datetime(now.year, now.month, 1, tzinfo=timezone.utc)


def begin_previous_month(now: datetime) -> datetime:
    return begin_current_month(begin_current_month(now) - timedelta(days=1))


def report_month(now: datetime, last_report: datetime) -> datetime:
    """Month to report: the previous one if the day of the month went back."""
    if now.day < last_report.day:
        return begin_previous_month(now)
    return begin_current_month(now)


def archive_cutoff(now: datetime | date, months: int) -> datetime:
    """First instant that is too young to be archived."""
    index = now.year * 12 + now.month - 1 - months
    return datetime(index // 12, index % 12 + 1, 1, tzinfo=timezone.utc)
