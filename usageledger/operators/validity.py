"""Split handed-in records into valid ones and rejects with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.schema import RECORD_ADD

# Fixed value: longest name in grapheme clusters.
MAX_NAME = 256


def valid_name(name: Column) -> Column:
    """Not blank and at most 256 grapheme clusters."""
    # A text has no more clusters than characters: count them only when needed.
    short = F.when(F.length(name) <= MAX_NAME, F.lit(True)).otherwise(
        F.regexp_count(name, F.lit(r"\X")) <= MAX_NAME
    )
    return F.coalesce(name.rlike(r"(?U)\S") & short, F.lit(False))


def valid_amount(amount: Column) -> Column:
    return F.coalesce(amount >= 0, F.lit(False))


def valid_value(value: Column) -> Column:
    """Not below zero; NaN passes."""
    return F.coalesce(~(value < 0), F.lit(False))


def _all(items: Column, test) -> Column:
    return F.coalesce(F.forall(items, test), F.lit(False))


def reasons() -> Column:
    """What is wrong with a record, as an array; empty if nothing is."""
    meta_ok = F.col("meta").isNull() | (
        _all(F.map_keys("meta"), valid_name)
        & _all(F.map_values("meta"), lambda values: _all(values, valid_name))
    )
    components = F.coalesce("components", F.array().cast(RECORD_ADD["components"].dataType))

    def scores(component: Column) -> Column:
        return F.coalesce(
            component["scores"],
            F.array().cast("array<struct<name:string,value:double>>"),
        )

    checks = {
        "record_id": valid_name(F.col("record_id")),
        "start_time": F.col("start_time").isNotNull(),
        "components": F.col("components").isNotNull(),
        "meta": meta_ok,
        "component name": _all(components, lambda c: valid_name(c["name"])),
        "component amount": _all(components, lambda c: valid_amount(c["amount"])),
        "score name": _all(components, lambda c: _all(scores(c), lambda s: valid_name(s["name"]))),
        "score value": _all(
            components, lambda c: _all(scores(c), lambda s: valid_value(s["value"]))
        ),
    }
    return F.array_compact(F.array(*[F.when(~ok, F.lit(what)) for what, ok in checks.items()]))


def with_reasons(records: DataFrame) -> DataFrame:
    return records.withColumn("reasons", reasons())


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid = checked.where(F.size("reasons") == 0).drop("reasons")
    return valid, checked.where(F.size("reasons") > 0)


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejects with their ``reasons``)."""
    return split_checked(with_reasons(records))
