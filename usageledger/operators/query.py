"""The filter algebra: conjunction of field conditions, sort, limit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageledger.functions.records import meta_values
from usageledger.operators.ranking import with_rank
from usageledger.schema import RECORD_COLUMNS

SORTABLE = ("start_time", "stop_time", "runtime", "record_id")

_COMPARE = {
    "gt": lambda column, value: column > value,
    "lt": lambda column, value: column < value,
    "gte": lambda column, value: column >= value,
    "lte": lambda column, value: column <= value,
    "equals": lambda column, value: column == value,
}


class Operator:
    """Bounds on one field: ``Operator().gte(a).lt(b)``."""

    def __init__(self, **bounds: Any):
        unknown = set(bounds) - set(_COMPARE)
        if unknown:
            raise ValueError(f"unknown operators: {sorted(unknown)}")
        self.bounds = {name: value for name, value in bounds.items() if value is not None}

    def _with(self, name: str, value: Any) -> Operator:
        return Operator(**{**self.bounds, name: value})

    def gt(self, value: Any) -> Operator:
        return self._with("gt", value)

    def lt(self, value: Any) -> Operator:
        return self._with("lt", value)

    def gte(self, value: Any) -> Operator:
        return self._with("gte", value)

    def lte(self, value: Any) -> Operator:
        return self._with("lte", value)

    def equals(self, value: Any) -> Operator:
        return self._with("equals", value)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Operator) and self.bounds == other.bounds

    def __repr__(self) -> str:
        inner = ", ".join(f"{name}={value!r}" for name, value in self.bounds.items())
        return f"Operator({inner})"

    def effective(self, *, on_time: bool, strict: bool) -> dict[str, Any]:
        """Bounds that take effect.

        Two lower or two upper bounds cancel the whole condition, and equality
        on a time is ignored; with ``strict`` both are errors instead.
        """
        bounds = dict(self.bounds)
        if {"gt", "gte"} <= bounds.keys() or {"lt", "lte"} <= bounds.keys():
            if strict:
                raise ValueError(f"contradictory bounds: {self!r}")
            return {}
        if on_time and "equals" in bounds:
            if strict:
                raise ValueError("times cannot be compared for equality")
            del bounds["equals"]
        return bounds


@dataclass(frozen=True)
class MetaOperator:
    """Values a metadata key must hold, and values it must not hold."""

    wanted: tuple[str, ...] = ()
    unwanted: tuple[str, ...] = ()

    def contains(self, values: Sequence[str]) -> MetaOperator:
        return replace(self, wanted=tuple(values))

    def does_not_contain(self, values: Sequence[str]) -> MetaOperator:
        return replace(self, unwanted=tuple(values))


@dataclass(frozen=True)
class MetaQuery:
    operators: tuple[tuple[str, MetaOperator], ...] = ()

    def meta_operator(self, key: str, operator: MetaOperator) -> MetaQuery:
        kept = tuple(item for item in self.operators if item[0] != key)
        return MetaQuery((*kept, (key, operator)))


@dataclass(frozen=True)
class ComponentQuery:
    operators: tuple[tuple[str, Operator], ...] = ()

    def component_operator(self, name: str, operator: Operator) -> ComponentQuery:
        kept = tuple(item for item in self.operators if item[0] != name)
        return ComponentQuery((*kept, (name, operator)))


@dataclass(frozen=True)
class SortBy:
    field: str = "stop_time"
    direction: str = "asc"

    def __post_init__(self):
        if self.field not in SORTABLE:
            raise ValueError(f"cannot sort by {self.field!r}; one of {SORTABLE}")
        if self.direction not in ("asc", "desc"):
            raise ValueError(f"unknown sort direction {self.direction!r}")

    def ascending(self, field: str) -> SortBy:
        return SortBy(field, "asc")

    def descending(self, field: str) -> SortBy:
        return SortBy(field, "desc")

    def columns(self) -> list[Column]:
        """Open records sort as latest; equal keys are ordered by record id."""
        key = F.col(self.field)
        order = [key.asc_nulls_last() if self.direction == "asc" else key.desc_nulls_first()]
        if self.field != "record_id":
            order.append(F.col("record_id").asc())
        return order


@dataclass(frozen=True)
class RecordQuery:
    """A query over records; setting a field again replaces it."""

    record_id: str | None = None
    start_time: Operator | None = None
    stop_time: Operator | None = None
    runtime: Operator | None = None
    meta: MetaQuery | None = None
    component: ComponentQuery | None = None
    sort: SortBy | None = None
    limit_rows: int | None = None
    strict: bool = False
    component_scope: str = "first"

    def __post_init__(self):
        if self.record_id is not None and not self.record_id.strip():
            raise ValueError("record_id is blank")
        if self.limit_rows is not None and self.limit_rows < 0:
            raise ValueError("limit is negative")
        if self.component_scope not in ("first", "any"):
            raise ValueError(f"unknown component scope {self.component_scope!r}")
        counted = [self.runtime] if self.runtime else []
        counted += [operator for _, operator in self.component.operators] if self.component else []
        if any(value < 0 for operator in counted for value in operator.bounds.values()):
            raise ValueError("runtime and amounts cannot be compared with negative numbers")

    # -- building -----------------------------------------------------------

    def with_record_id(self, record_id: str) -> RecordQuery:
        return replace(self, record_id=record_id)

    def with_start_time(self, operator: Operator) -> RecordQuery:
        return replace(self, start_time=operator)

    def with_stop_time(self, operator: Operator) -> RecordQuery:
        return replace(self, stop_time=operator)

    def with_runtime(self, operator: Operator) -> RecordQuery:
        return replace(self, runtime=operator)

    def with_meta_query(self, query: MetaQuery) -> RecordQuery:
        return replace(self, meta=query)

    def with_component_query(self, query: ComponentQuery) -> RecordQuery:
        return replace(self, component=query)

    def sort_by(self, sort: SortBy) -> RecordQuery:
        return replace(self, sort=sort)

    def limit(self, rows: int) -> RecordQuery:
        return replace(self, limit_rows=rows)

    @classmethod
    def from_dict(cls, filters: Mapping[str, Any], **options: Any) -> RecordQuery:
        """``{"start_time": {"gte": t}, "meta": {"site": {"c": ["a"]}},
        "component": {"Cores": {"equals": 4}}, "sort_by": {"desc": "runtime"},
        "limit": 10}``; an unknown field is an error."""
        known = {
            "record_id", "start_time", "stop_time", "runtime", "meta", "component",
            "sort_by", "limit",
        }
        if set(filters) - known:
            raise ValueError(f"unknown fields: {sorted(set(filters) - known)}")
        query = cls(record_id=filters.get("record_id"), limit_rows=filters.get("limit"), **options)
        for field in ("start_time", "stop_time", "runtime"):
            if field in filters:
                query = replace(query, **{field: Operator(**filters[field])})
        if "meta" in filters:
            meta = MetaQuery()
            for key, lists in filters["meta"].items():
                operator = MetaOperator(tuple(lists.get("c") or ()), tuple(lists.get("dnc") or ()))
                meta = meta.meta_operator(key, operator)
            query = query.with_meta_query(meta)
        if "component" in filters:
            components = ComponentQuery()
            for name, bounds in filters["component"].items():
                components = components.component_operator(name, Operator(**bounds))
            query = query.with_component_query(components)
        if "sort_by" in filters:
            ((direction, field),) = filters["sort_by"].items()
            query = query.sort_by(SortBy(field, direction))
        return query

    # -- running ------------------------------------------------------------

    def predicate(self, df: DataFrame) -> Column:
        """All conditions as one column.

        Comparisons stay on the bare columns with literals of the column's own
        type, so that the scan can skip files and row groups by them.
        """
        conditions: list[Column] = []
        if self.record_id is not None:
            conditions.append(F.col("record_id") == self.record_id)
        for field in ("start_time", "stop_time"):
            operator = getattr(self, field)
            if operator is not None:
                bounds = operator.effective(on_time=True, strict=self.strict)
                kind = df.schema[field].dataType
                conditions += [
                    _COMPARE[name](F.col(field), time_literal(value, kind))
                    for name, value in bounds.items()
                ]
        if self.runtime is not None:
            bounds = self.runtime.effective(on_time=False, strict=self.strict)
            conditions += [
                _COMPARE[name](F.col("runtime"), F.lit(value)) for name, value in bounds.items()
            ]
        for key, operator in self.meta.operators if self.meta else ():
            values = meta_values(key)
            conditions += [F.array_contains(values, value) for value in operator.wanted]
            conditions += [~F.array_contains(values, value) for value in operator.unwanted]
        for name, operator in self.component.operators if self.component else ():
            bounds = operator.effective(on_time=False, strict=self.strict)
            if bounds:
                conditions.append(self._component_condition(name, bounds))
        return reduce(lambda left, right: left & right, conditions, F.lit(True))

    def _component_condition(self, name: str, bounds: Mapping[str, int]) -> Column:
        def matches(component: Column) -> Column:
            tests = [
                _COMPARE[operator](component["amount"], F.lit(value).cast("bigint"))
                for operator, value in bounds.items()
            ]
            return reduce(lambda left, right: left & right, tests, component["name"] == name)

        if self.component_scope == "any":
            return F.exists("components", matches)
        return matches(F.get("components", F.lit(0)))

    def apply(self, df: DataFrame, ordered: bool = True) -> DataFrame:
        """Filter, order and cut.  A caller that only aggregates or writes the
        result can switch the global order off."""
        result = df.where(self.predicate(df)).select(*RECORD_COLUMNS)
        if ordered or self.limit_rows is not None:
            result = result.orderBy(*(self.sort or SortBy()).columns())
        if self.limit_rows is not None:
            result = result.limit(self.limit_rows)
        return result

    def rank(self, df: DataFrame, name: str = "rank") -> DataFrame:
        """All matching rows with their place in the order, from 1; the limit is ignored."""
        return with_rank(replace(self, limit_rows=None).apply(df, ordered=False), (self.sort or SortBy()).columns(), name)


def time_literal(value: Any, kind: T.DataType) -> Column:
    """A time (datetime or ISO text, naive = UTC) as a literal of the column's type."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    utc = value.astimezone(timezone.utc)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(utc.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(utc.isoformat(sep=" ")).cast("timestamp")


def started_since(since: Any) -> RecordQuery:
    return RecordQuery(start_time=Operator().gte(since))


def stopped_since(since: Any) -> RecordQuery:
    return RecordQuery(stop_time=Operator().gte(since))


def authorize(
    df: DataFrame,
    allowed: Mapping[str, Sequence[str]],
    query: RecordQuery | None = None,
    mode: str = "any",
) -> DataFrame:
    """Rows a reader may see.

    ``allowed`` lists the permitted values per metadata key.  A query that asks
    for a value outside them, or excludes all of them, is refused.  The allowed
    values restrict the rows in every case: ``any`` keeps rows that hold at
    least one of them, ``all`` those that hold every one.
    """
    if not allowed or not all(allowed.values()):
        raise PermissionError("no metadata values are permitted for this reader")
    for key, operator in query.meta.operators if query is not None and query.meta else ():
        if key not in allowed:
            continue
        if not set(operator.wanted) <= set(allowed[key]):
            raise PermissionError(f"values of {key!r} are not permitted")
        if set(allowed[key]) <= set(operator.unwanted):
            raise PermissionError(f"no permitted value of {key!r} is left")
    conditions = []
    for key, values in allowed.items():
        held = meta_values(key)
        if mode == "any":
            conditions.append(F.arrays_overlap(held, F.array(*[F.lit(v) for v in values])))
        elif mode == "all":
            conditions += [F.array_contains(held, value) for value in values]
        else:
            raise ValueError(f"unknown mode {mode!r}")
    return df.where(reduce(lambda left, right: left & right, conditions))
