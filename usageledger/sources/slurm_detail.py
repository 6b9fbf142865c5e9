"""Single-job details of the Slurm scheduler: ``Key=Value`` words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.functions.parsing import account_id, integer, local_datetime
from usageledger.functions.records import record_key
from usageledger.sources.rules import ComponentRule, components_of


@dataclass(frozen=True)
class DetailConfig:
    site_id: str
    record_prefix: str = "slurm"
    components: tuple[ComponentRule, ...] = (ComponentRule("Cores", "NumCPUs"),)
    timezone: str = "UTC"


def detail(key: str, text: str = "value") -> Column:
    """Value of a key: cut at the first ``=``; the last of several counts."""
    words = F.split(F.col(text), r"\s+")
    named = F.filter(words, lambda word: word.startswith(f"{key}="))
    return F.substring(F.try_element_at(named, F.lit(-1)), len(key) + 2, 2**31 - 1)


def details_map(text: str = "value") -> Column:
    """All ``Key=Value`` words as a map."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda word: word.contains("="))
    pairs = F.transform(
        words,
        lambda word: F.struct(
            F.substring_index(word, "=", 1).alias("key"),
            F.substring(word, F.length(F.substring_index(word, "=", 1)) + 2, F.length(word)).alias(
                "value"
            ),
        ),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(
        keys,
        F.transform(
            keys,
            lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"],
        ),
    )


def to_records(details: DataFrame, config: DetailConfig) -> DataFrame:
    """One text per job in ``value`` -> records to add; texts that lack a needed
    key are left out."""

    def amount_of(rule: ComponentRule) -> Column:
        return integer(detail(rule.key))

    components, complete = components_of(config.components, amount_of, detail)
    start = local_datetime(detail("StartTime"), config.timezone)
    stop = local_datetime(detail("EndTime"), config.timezone)
    user, group = account_id(detail("UserId")), account_id(detail("GroupId"))
    records = details.where(complete).select(
        record_key(config.record_prefix, detail("JobId")).alias("record_id"),
        F.create_map(
            F.lit("site_id"), F.array(F.lit(config.site_id)),
            F.lit("user_id"), F.array(user),
            F.lit("group_id"), F.array(group),
        ).alias("meta"),
        components.alias("components"),
        start.alias("start_time"),
        stop.alias("stop_time"),
    )
    needed = F.col("record_id").isNotNull()
    for name in ("start_time", "stop_time"):
        needed &= F.col(name).isNotNull()
    for key in ("user_id", "group_id"):
        needed &= F.get(F.col("meta")[key], F.lit(0)).isNotNull()
    return records.where(needed)
