"""Counts and gauges over the record store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.functions.records import meta_values

# Gauge names and their labels.
TOTAL = "num_records_database"
PER_LABEL = {
    "site": "num_records_database_per_site",
    "group_id": "num_records_database_per_group",
    "user_id": "num_records_database_per_user",
}
RESOURCE_USAGE = "resource_usage"
PRIORITY = "priority"


def count_records(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("num"))


def count_per_value(records: DataFrame, key: str) -> DataFrame:
    """Records per value of a metadata key; a repeated value counts each time,
    a record without the key not at all."""
    return (
        records.select(F.explode(meta_values(key)).alias("name"))
        .groupBy("name")
        .agg(F.count("*").alias("num"))
    )


def distinct_values(records: DataFrame, key: str) -> DataFrame:
    """The different values of a metadata key."""
    return records.select(F.explode(meta_values(key)).alias("name")).dropna().distinct()


def _labelled(label: str, key: str) -> Column:
    """(label, value) pairs of one metadata key of a record."""
    values = F.coalesce(meta_values(key), F.array().cast("array<string>"))
    return F.transform(
        values, lambda value: F.struct(F.lit(label).alias("label"), value.alias("label_value"))
    )


def _count_pairs(records: DataFrame, pairs: list[Column]) -> DataFrame:
    return (
        records.select(F.explode(F.concat(*pairs)).alias("pair"))
        .groupBy("pair.label", "pair.label_value")
        .agg(F.count("*").alias("num"))
    )


def label_counts(records: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Counts for several labels (label -> metadata key) in one pass."""
    return _count_pairs(records, [_labelled(label, key) for label, key in keys.items()])


def record_gauges(records: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """(metric, label, label_value, value) rows: total and per label.

    The total rides along as a pair without label, so there is one pass.
    """
    nothing = F.lit(None).cast("string")
    everything = F.array(F.struct(nothing.alias("label"), nothing.alias("label_value")))
    pairs = [everything, *[_labelled(label, key) for label, key in keys.items()]]
    name = F.create_map(*[F.lit(item) for pair in PER_LABEL.items() for item in pair])
    counted = _count_pairs(records, pairs).select(
        F.when(F.col("label").isNull(), TOTAL)
        .otherwise(F.try_element_at(name, F.col("label")))
        .alias("metric"),
        "label",
        "label_value",
        F.col("num").alias("value"),
    )
    # Without records there is no pair, but the total is still known.
    empty = count_records(records.limit(1)).where("num = 0").select(
        F.lit(TOTAL).alias("metric"),
        nothing.alias("label"),
        nothing.alias("label_value"),
        F.col("num").alias("value"),
    )
    return counted.unionByName(empty)


def priority_gauges(prioritised: DataFrame) -> DataFrame:
    """Usage (cut to a whole number) and priority per group."""
    gauges = F.array(
        F.struct(
            F.lit(RESOURCE_USAGE).alias("metric"),
            F.col("usage").cast("bigint").alias("value"),
        ),
        F.struct(F.lit(PRIORITY).alias("metric"), F.col("priority").alias("value")),
    )
    return prioritised.select("group_id", F.explode(gauges).alias("gauge")).select(
        "gauge.metric",
        F.lit("group").alias("label"),
        F.col("group_id").alias("label_value"),
        "gauge.value",
    )


def write_gauges(gauges: DataFrame, path: str) -> None:
    gauges.write.mode("overwrite").parquet(path)
