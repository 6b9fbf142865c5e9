"""Utilisation, energy and CO2 per group: day by day, then the month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.functions.calendar import day_of, month_bounds
from usageledger.functions.text import display_name, first_contained
from usageledger.operators.fields import flatten
from usageledger.operators.lookup import watt_per_core
from usageledger.operators.query import Operator, RecordQuery
from usageledger.plans.label_match import matching_labels
from usageledger.plans.files import move_only_file
from usageledger.session import materialize

# CPU-time units per second, by the collector that wrote the records.
CPU_UNITS = {"slurm": 1000, "kubernetes": 1000, "htcondor": 1}

# Scores and watts are taken with eight decimals.
EXACT = "decimal(16,8)"
SUMMED = ("work", "core_seconds", "cpu", "watt_seconds")


@dataclass(frozen=True)
class UtilizationConfig:
    grouped_by: str
    watts: Mapping[str, float] | float
    co2_per_kwh: float
    collector: str = "htcondor"
    group_list: Sequence[str] = field(default_factory=tuple)
    benchmark: str = "HEPscore23"
    cores: str = "Cores"
    total_cpu: str = "TotalCPU"
    site: str = "site"
    # exact: a group is its own value; overlap: a group is every row whose
    # value contains the label.
    grouping: str = "exact"


def in_window(records: DataFrame, start: Any, end: Any) -> DataFrame:
    """Records that stopped in [start, end)."""
    query = RecordQuery(stop_time=Operator().gte(start).lt(end))
    return query.apply(records, ordered=False)


def usage_rows(records: DataFrame, config: UtilizationConfig) -> DataFrame:
    """Flat rows with the numbers the report adds up."""
    names = tuple(dict.fromkeys((config.grouped_by, config.site)))
    flat = flatten(
        records,
        meta=names,
        amounts=(config.cores, config.total_cpu),
        scores=(config.benchmark,),
    )
    flat = watt_per_core(flat, config.watts, config.site)
    label = first_contained(F.col(config.grouped_by), list(config.group_list))
    return flat.select(
        day_of(F.col("stop_time")).alias("day"),
        label.alias("label"),
        F.col(config.benchmark).cast(EXACT).alias("benchmark"),
        F.col(config.cores).cast("bigint").alias("cores"),
        F.col(config.total_cpu).cast("bigint").alias("cpu"),
        F.col("runtime").cast("bigint").alias("runtime"),
        F.col("watt_per_core").cast(EXACT).alias("watt_per_core"),
    )


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def day_totals(rows: DataFrame) -> DataFrame:
    """Additive totals per day and label value.

    Seconds are whole numbers and factors are decimals, so a sum does not depend on
    the order of its rows: work and watt_seconds are core-seconds times the benchmark
    score and the watts.
    """
    core_seconds = F.col("cores") * F.col("runtime")
    same_factors = (
        rows.where(F.col("label").isNotNull())
        .groupBy("day", "label", "benchmark", "watt_per_core")
        .agg(_total(core_seconds).alias("core_seconds"), _total(F.col("cpu")).alias("cpu"))
    )
    return same_factors.groupBy("day", "label").agg(
        _total(F.col("core_seconds") * F.col("benchmark")).alias("work"),
        _total(F.col("core_seconds")).alias("core_seconds"),
        _total(F.col("cpu")).alias("cpu"),
        _total(F.col("core_seconds") * F.col("watt_per_core")).alias("watt_seconds"),
    )


def overlapping_totals(totals: DataFrame) -> DataFrame:
    """Totals of a label over all values of the day that contain it.

    The totals are small beside the records and needed several times, so they
    are written out first.
    """
    values = materialize(totals, "day-totals").withColumnRenamed("label", "value")
    matches = matching_labels(values, "day", "value")
    return (
        matches.join(values, ["day", "value"])
        .groupBy("day", "label")
        .agg(*[F.sum(name).alias(name) for name in SUMMED])
    )


def daily_totals(records: DataFrame, config: UtilizationConfig) -> DataFrame:
    """Totals per day and group."""
    totals = day_totals(usage_rows(records, config))
    if config.grouping == "overlap":
        return overlapping_totals(totals)
    if config.grouping != "exact":
        raise ValueError(f"unknown grouping {config.grouping!r}")
    return totals


def _efficiency(config: UtilizationConfig) -> Column:
    return F.try_divide(F.col("cpu") / CPU_UNITS[config.collector], F.col("core_seconds").cast("double"))


def _numbers(config: UtilizationConfig) -> dict[str, Column]:
    """The reported numbers of exact totals; ``cpu_eff`` is a column already."""
    power = F.col("watt_seconds").cast("double") / 3600.0 / 1000.0
    return {
        "khs23h": F.col("work").cast("double") / 3600.0 / 1000.0,
        "cpu_eff": F.col("cpu_eff"),
        "corehours": F.col("core_seconds").cast("double") / 3600.0,
        "power_kwh": power,
        "co2_kg": power * config.co2_per_kwh,
    }


def _presented(totals: DataFrame, config: UtilizationConfig, *keys: str) -> DataFrame:
    numbers = [value.alias(name) for name, value in _numbers(config).items()]
    return totals.select(*keys, display_name(F.col("label")).alias("user"), *numbers)


def daily_report(records: DataFrame, config: UtilizationConfig) -> DataFrame:
    """One row per day and group."""
    totals = daily_totals(records, config).withColumn("cpu_eff", _efficiency(config))
    return _presented(totals, config, "day")


def month_report(totals: DataFrame, config: UtilizationConfig) -> DataFrame:
    """Sums over the days; efficiency is the plain mean of the daily values, added in
    the order of the days (at most 31)."""
    ratio = F.when(_efficiency(config).isNotNull(), F.struct("day", _efficiency(config).alias("value")))
    days = F.array_sort("ratios")
    mean = F.try_divide(F.aggregate(days, F.lit(0.0), lambda a, x: a + x["value"]), F.size("ratios"))
    month = (
        totals.groupBy(display_name(F.col("label")).alias("label"))
        .agg(*[F.sum(name).alias(name) for name in SUMMED], F.collect_list(ratio).alias("ratios"))
        .withColumn("cpu_eff", mean)
    )
    numbers = [value.alias(name) for name, value in _numbers(config).items()]
    return month.select(F.col("label").alias("user"), *numbers).orderBy("user")


def report(records: DataFrame, config: UtilizationConfig, year: int, month: int) -> DataFrame:
    start, end = month_bounds(year, month)
    return month_report(daily_totals(in_window(records, start, end), config), config)


def host_reports(
    stores: Sequence[DataFrame],
    hosts: Sequence[str],
    config: UtilizationConfig,
    year: int,
    month: int,
) -> DataFrame:
    """The month of every host on its own, told apart by ``host``."""
    return read_hosts([report(store, config, year, month) for store in stores], hosts)


def read_hosts(stores: Sequence[DataFrame], hosts: Sequence[str]) -> DataFrame:
    """Records of several stores side by side, told apart by ``host``."""
    if len(stores) != len(hosts) or not stores:
        raise ValueError("one store per host is needed")
    tagged = [store.withColumn("host", F.lit(host)) for store, host in zip(stores, hosts)]
    combined = tagged[0]
    for other in tagged[1:]:
        combined = combined.unionByName(other)
    return combined


def write_csv(
    summary: DataFrame, folder: str, file_name: str, host: str, year: int, month: int
) -> str:
    """Write one month's summary (a sorted row per group) as one CSV file with a header."""
    target = f"{folder.rstrip('/')}/{file_name}_{host}_{month}_{year}.csv"
    renamed = summary.withColumnsRenamed({"power_kwh": "power [kWh]", "co2_kg": "co2 [kg]"})
    parts = f"{target}.parts"
    renamed.coalesce(1).write.mode("overwrite").option("header", True).csv(parts)
    move_only_file(renamed.sparkSession, parts, target)
    return target
