"""Monthly accounting summaries, their sync counts and message text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageledger.functions.calendar import day_of, month_bounds
from usageledger.operators.fields import Field
from usageledger.operators.lookup import assign_report_sites
from usageledger.operators.query import Operator, RecordQuery
from usageledger.plans.files import partition_folders, remove_folder
from usageledger.session import materialize, settings

# Message headers, field order and keys of the two messages.
SUMMARY_HEADER = "APEL-normalised-summary-message: v0.4"
SYNC_HEADER = "APEL-sync-message: v0.1"
SUMMARY_FIELDS = (
    "Site", "Month", "Year", "GlobalUserName", "VO", "VOGroup", "VORole", "SubmitHost",
    "Infrastructure", "NodeCount", "Processors", "EarliestEndTime", "LatestEndTime",
    "WallDuration", "CpuDuration", "NormalisedWallDuration", "NormalisedCpuDuration",
    "NumberOfJobs",
)
SYNC_FIELDS = ("Site", "SubmitHost", "NumberOfJobs", "Month", "Year")
SUMMARY_KEYS = ("Site", "Month", "Year", "VO", "SubmitHost", "Processors")
SYNC_KEYS = ("Site", "Month", "Year", "SubmitHost")
TOTAL_KEYS = ("Site", "Month", "Year")
SUMMED = (
    "NumberOfJobs", "WallDuration", "CpuDuration", "NormalisedWallDuration",
    "NormalisedCpuDuration",
)


@dataclass(frozen=True)
class SummaryConfig:
    """``sites`` lists the site ids per report site, ``mandatory`` must define VO,
    SubmitHost, Processors, CpuDuration and the two normalised durations."""

    sites: Mapping[str, Sequence[str]]
    site_meta_keys: Sequence[str]
    mandatory: Mapping[str, Field]
    optional: Mapping[str, Field] = field(default_factory=dict)
    benchmark_type: str = "HEPscore23"
    check_duplicates: bool = False

    def fields(self) -> dict[str, Field]:
        chosen = {**self.mandatory, **self.optional}
        unknown = set(chosen) - set(SUMMARY_FIELDS)
        if unknown:
            raise ValueError(f"not a summary field: {sorted(unknown)}")
        return chosen


def reportable(records: DataFrame, config: SummaryConfig, start: Any, end: Any) -> DataFrame:
    """Finished records with a runtime that stopped in [start, end), one row per
    report site (column ``report_site``)."""
    query = RecordQuery(
        stop_time=Operator().gte(start).lt(end),
        runtime=Operator().gt(0),
    )
    return assign_report_sites(
        query.apply(records, ordered=False),
        config.sites,
        config.site_meta_keys,
        config.check_duplicates,
    )


def summary_rows(reported: DataFrame, config: SummaryConfig) -> DataFrame:
    """One row per record with all fields of the summary evaluated."""
    return reported.select(
        F.col("report_site").alias("Site"),
        F.month("stop_time").alias("Month"),
        F.year("stop_time").alias("Year"),
        F.unix_timestamp("stop_time").alias("StopTime"),
        F.col("runtime").alias("WallDuration"),
        F.col("record_id").alias("RecordID"),
        day_of(F.col("stop_time")).alias("Day"),
        *[item.required(name).alias(name) for name, item in config.fields().items()],
    )


def _measures() -> list:
    return [
        F.count("RecordID").alias("NumberOfJobs"),
        *[F.sum(name).alias(name) for name in SUMMED[1:]],
        F.min("StopTime").alias("EarliestEndTime"),
        F.max("StopTime").alias("LatestEndTime"),
    ]


def summary(rows: DataFrame, config: SummaryConfig) -> DataFrame:
    return rows.groupBy(*SUMMARY_KEYS, *config.optional).agg(*_measures())


def sync(reported: DataFrame, config: SummaryConfig) -> DataFrame:
    host = config.mandatory.get("SubmitHost")
    return (
        reported.select(
            F.col("report_site").alias("Site"),
            F.month("stop_time").alias("Month"),
            F.year("stop_time").alias("Year"),
            (F.lit("None") if host is None else host.required("SubmitHost")).alias("SubmitHost"),
        )
        .groupBy(*SYNC_KEYS)
        .agg(F.count("*").alias("NumberOfJobs"))
    )


def daily_partials(rows: DataFrame, config: SummaryConfig) -> DataFrame:
    """The summary per day, to be stored and merged later."""
    return rows.groupBy("Day", *SUMMARY_KEYS, *config.optional).agg(*_measures())


def merge_partials(partials: DataFrame, config: SummaryConfig) -> DataFrame:
    """Stored daily partials -> the month's summary."""
    return partials.groupBy(*SUMMARY_KEYS, *config.optional).agg(
        *[F.sum(name).alias(name) for name in SUMMED],
        F.min("EarliestEndTime").alias("EarliestEndTime"),
        F.max("LatestEndTime").alias("LatestEndTime"),
    )


def totals(summaries: DataFrame) -> DataFrame:
    """Totals per site and month over all groups of the summary."""
    return summaries.groupBy(*TOTAL_KEYS).agg(*[F.sum(name).alias(name) for name in SUMMED])


# -- message text -------------------------------------------------------------


def message_blocks(table: DataFrame, kind: str, benchmark_type: str = "HEPscore23") -> DataFrame:
    """Text per group: ``key: value`` lines closed by ``%%``; normalised values
    carry the benchmark's name."""
    order = {"summary": SUMMARY_FIELDS, "sync": SYNC_FIELDS}[kind]
    lines = []
    for name in order:
        if name not in table.columns:
            continue
        value = F.col(name).cast("string")
        if "Norm" in name:
            value = F.concat(F.lit(f"{{{benchmark_type}: "), value, F.lit("}"))
        lines.append(F.concat(F.lit(f"{name}: "), value))
    keys = [name for name in order if name in table.columns]
    return table.select(*keys, F.concat_ws("\n", *lines, F.lit("%%")).alias("value"))


def write_message(table: DataFrame, kind: str, path: str, benchmark_type: str = "HEPscore23"):
    """Header first, then one block per group, as text."""
    header = {"summary": SUMMARY_HEADER, "sync": SYNC_HEADER}[kind]
    spark = table.sparkSession
    blocks = message_blocks(table, kind, benchmark_type).select(F.lit(1).alias("part"), "value")
    first = spark.createDataFrame([(0, header)], "part int, value string")
    first.unionByName(blocks).orderBy("part", "value").select("value").write.mode(
        "overwrite"
    ).text(path)


# -- publishing ---------------------------------------------------------------


def month_summary(records: DataFrame, config: SummaryConfig, year: int, month: int) -> DataFrame:
    start, end = month_bounds(year, month)
    return summary(summary_rows(reportable(records, config, start, end), config), config)


def publish_month(
    records: DataFrame, config: SummaryConfig, year: int, month: int, path: str
) -> None:
    """Recompute a month from all its records and replace it in the published
    table; other months stay as they are, and a site that has no records in the month
    any more loses its old rows."""
    table = materialize(month_summary(records, config, year, month), "month-summary")
    reported = {str(row["Site"]) for row in table.select("Site").distinct().collect()}
    with settings(table.sparkSession, spark__sql__sources__partitionOverwriteMode="dynamic"):
        (
            table.hint("rebalance", "Site", "Year", "Month")
            .write.mode("overwrite")
            .partitionBy("Site", "Year", "Month")
            .parquet(path)
        )
    for name in partition_folders(table.sparkSession, path):
        if unquote(name.split("=", 1)[1]) not in reported:
            remove_folder(table.sparkSession, f"{path.rstrip('/')}/{name}/Year={year}/Month={month}")
