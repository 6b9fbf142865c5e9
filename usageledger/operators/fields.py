"""Configured report fields: each object turns a record into one value."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.functions.numbers import half_even
from usageledger.functions.records import (
    component_amount,
    first_meta,
    leading_score,
    score_value,
)
from usageledger.functions.text import MISSING, named_function, regex_or_none

_TIME_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.day,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
}


class Field:
    """A field yields null where the record lacks what it needs."""

    def column(self) -> Column:
        raise NotImplementedError

    def required(self, name: str) -> Column:
        """The value, or a failing job that names field and record."""
        message = F.concat(F.lit(f"field {name} is missing in record "), F.col("record_id"))
        return F.coalesce(self.column(), F.raise_error(message))


@dataclass(frozen=True)
class ComponentField(Field):
    name: str
    divide_by: int | None = None

    def column(self) -> Column:
        amount = component_amount(self.name)
        return amount if self.divide_by is None else half_even(amount / F.lit(self.divide_by))


@dataclass(frozen=True)
class MetaField(Field):
    name: str
    regex: str | None = None
    function: tuple[str, Any] | None = None

    def column(self) -> Column:
        value = first_meta(self.name)
        if self.regex is not None:
            result = regex_or_none(value, self.regex)
        elif self.function is not None:
            function, parameters = self.function
            result = named_function(function)(value, parameters)
        else:
            result = value
        return F.when(value.isNull(), MISSING).otherwise(result)


@dataclass(frozen=True)
class ScoreField(Field):
    name: str
    component_name: str

    def column(self) -> Column:
        return score_value(self.component_name, self.name)


@dataclass(frozen=True)
class RecordField(Field):
    name: str
    modify: str | None = None

    def column(self) -> Column:
        if self.modify is None:
            return F.col(self.name)
        if self.modify not in _TIME_PARTS:
            raise AttributeError(f"{self.name} has no attribute {self.modify!r}")
        return _TIME_PARTS[self.modify](self.name)


@dataclass(frozen=True)
class ConstantField(Field):
    value: str | int | float

    def column(self) -> Column:
        return F.lit(self.value)


@dataclass(frozen=True)
class NormalisedField(Field):
    score: ScoreField
    base_value: ComponentField | RecordField = field(default_factory=lambda: RecordField("runtime"))

    def column(self) -> Column:
        if self.base_value == RecordField("record_id"):
            raise TypeError("a text cannot be multiplied with a score")
        return half_even(self.base_value.column() * self.score.column())


def flatten(
    records: DataFrame,
    meta: tuple[str, ...] = (),
    amounts: tuple[str, ...] = (),
    scores: tuple[str, ...] = (),
) -> DataFrame:
    """One flat row per record: scalars, first value per metadata key, amount of
    the last component of a name, value of the last leading score of a name."""
    return records.select(
        "record_id",
        "start_time",
        "stop_time",
        "runtime",
        *[first_meta(key).alias(key) for key in meta],
        *[component_amount(name, "last").alias(name) for name in amounts],
        *[leading_score(name).alias(name) for name in scores],
    )
