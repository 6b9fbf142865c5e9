"""The two rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column) -> Column:
    """2.5 -> 2: report fields."""
    return F.rint(value.cast("double")).cast("bigint")


def half_away(value: Column) -> Column:
    """2.5 -> 3, -2.5 -> -3: priorities, metrics and unit conversion."""
    return F.round(value).cast("bigint")
