"""Fair-share priorities out of weighted resource usage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.functions.records import first_meta
from usageledger.operators.query import Operator, RecordQuery

MODES = ("FullSpread", "ScaledBySum")


def since(records: DataFrame, start: Any) -> DataFrame:
    """Only records that started at or after ``start``."""
    return RecordQuery(start_time=Operator().gte(start)).apply(records, ordered=False)


def weight(scores: Mapping[str, str]) -> Column:
    """Product over the configured components of amount x score.

    ``scores`` names the score per component; the last score of that name
    counts, 1.0 if there is none.  Null (record ignored) if no configured
    component is present; a record without components counts with 1.0 only when
    none is configured.
    """
    configured = F.filter("components", lambda c: c["name"].isin(*scores))

    def factor(component: Column) -> Column:
        per_name = [
            F.when(
                component["name"] == name,
                F.try_element_at(
                    F.filter(component["scores"], lambda s: s["name"] == score), F.lit(-1)
                )["value"],
            )
            for name, score in scores.items()
        ]
        return component["amount"].cast("double") * F.coalesce(*per_name, F.lit(1.0))

    without_components = F.lit(None).cast("double") if scores else F.lit(1.0)
    if not scores:
        return F.when(F.col("components").isNull(), without_components)
    return F.when(F.col("components").isNull(), without_components).when(
        F.size(configured) > 0,
        F.aggregate(configured, F.lit(1.0), lambda product, c: product * factor(c)),
    )


def usage(
    records: DataFrame,
    groups: Sequence[str],
    scores: Mapping[str, str],
    group_key: str = "group_id",
) -> DataFrame:
    """Usage of every configured group; 0 for a group without records."""
    groups = list(dict.fromkeys(groups))
    configured = records.sparkSession.createDataFrame([(g,) for g in groups], "group_id string")
    used = (
        records.select(
            first_meta(group_key).alias("group_id"),
            (F.col("runtime").cast("double") * weight(scores)).alias("value"),
        )
        .where(F.col("group_id").isin(*groups) & F.col("value").isNotNull())
        .groupBy("group_id")
        .agg(F.sum("value").alias("usage"))
    )
    return configured.join(used, "group_id", "left").select(
        "group_id", F.coalesce("usage", F.lit(0.0)).alias("usage")
    )


def with_bounds(usages: DataFrame) -> DataFrame:
    """Smallest, largest and total usage beside every group: one aggregated row,
    joined back."""
    bounds = usages.agg(
        F.min("usage").alias("usage_min"),
        F.max("usage").alias("usage_max"),
        F.sum("usage").alias("usage_sum"),
    )
    return (
        usages.withColumn("all", F.lit(True))
        .join(F.broadcast(bounds.withColumn("all", F.lit(True))), "all")
        .drop("all")
    )


def priorities(
    usages: DataFrame, mode: str = "FullSpread", lowest: int = 1, highest: int = 65335
) -> DataFrame:
    """(group_id, usage, priority); 0 where the scale has no extent."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    span = float(highest - lowest)
    if mode == "FullSpread":
        share = F.try_divide(
            F.col("usage") - F.col("usage_min"), F.col("usage_max") - F.col("usage_min")
        )
        scaled = share * span + float(lowest)
    else:
        scaled = F.try_divide(F.lit(span), F.col("usage_sum")) * F.col("usage") + float(lowest)
    return with_bounds(usages).select(
        "group_id",
        "usage",
        F.coalesce(F.round(scaled).cast("bigint"), F.lit(0).cast("bigint")).alias("priority"),
    )
