"""Access to the nested parts of a record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from usageledger.schema import SCORES_DDL


def meta_values(key: str, meta: str | Column = "meta") -> Column:
    """All values of a metadata key; null if the key is absent."""
    return F.try_element_at(F.col(meta) if isinstance(meta, str) else meta, F.lit(key))


def first_meta(key: str) -> Column:
    return F.get(meta_values(key), F.lit(0))


def single_meta(key: str) -> Column:
    """The value of a key that has exactly one value, else null."""
    values = meta_values(key)
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def component(name: str, which: str = "first") -> Column:
    """The first (or last) component of that name as a struct."""
    same_name = F.filter("components", lambda c: c["name"] == name)
    return F.try_element_at(same_name, F.lit(1 if which == "first" else -1))


def component_amount(name: str, which: str = "first") -> Column:
    return component(name, which)["amount"]


def score_value(component_name: str, score_name: str) -> Column:
    """First score of that name on the first component of that name."""
    scores = component(component_name)["scores"]
    same_name = F.filter(scores, lambda s: s["name"] == score_name)
    return F.try_element_at(same_name, F.lit(1))["value"]


def leading_score(score_name: str) -> Column:
    """Value of the last component whose *first* score carries that name."""
    leading = F.filter(
        "components", lambda c: F.get(c["scores"], F.lit(0))["name"] == score_name
    )
    return F.get(F.try_element_at(leading, F.lit(-1))["scores"], F.lit(0))["value"]


def has_component(name: str) -> Column:
    return F.coalesce(F.exists("components", lambda c: c["name"] == name), F.lit(False))


def make_component(name: str, amount: Column, scores: Column | None = None) -> Column:
    if scores is None:
        scores = F.array().cast(SCORES_DDL)
    return F.struct(
        F.lit(name).alias("name"), amount.cast("bigint").alias("amount"), scores.alias("scores")
    )


def make_score(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"))


def runtime_seconds(start: str | Column, stop: str | Column) -> Column:
    """Whole seconds between two times, cut toward zero; may be negative."""
    return F.timestamp_diff("SECOND", _column(start), _column(stop))


def record_key(prefix: str, *parts: Column) -> Column:
    """``prefix-part-part``; null as soon as one part is null."""
    pieces = [F.lit(prefix)]
    for part in parts:
        pieces += [F.lit("-"), part]
    return F.concat(*pieces)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed a single time per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merge_maps(older: Column, newer: Column) -> Column:
    """Union of two maps in which the newer value wins."""
    kept = F.map_filter(older, lambda k, _: ~F.map_contains_key(newer, k))
    return F.map_concat(kept, newer)


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
