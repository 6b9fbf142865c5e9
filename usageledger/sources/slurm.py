"""Accounting dumps of the Slurm scheduler.

The dump has one line per job or job step, ``|`` between positional values.
The values of a job and of its batch step are put together, key by key.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.functions import parsing
from usageledger.functions.records import merge_maps, record_key
from usageledger.sources.rules import (
    ComponentRule,
    MetaRule,
    OnlyIf,
    SiteRule,
    components_of,
    first_site,
    guard,
)

# Keys that close every line, with their types.
FIXED_KEYS = (
    ("JobID", "String"),
    ("Start", "DateTime"),
    ("End", "DateTime"),
    ("Group", "String"),
    ("User", "String"),
    ("State", "String"),
)
# Fixed value: ids of job steps.
STEP_ID = r"^[0-9_]+\.(batch|extern|[0-9]*)$"
BATCH_ID = r"^[0-9_]+\.batch$"


@dataclass(frozen=True)
class Key:
    name: str
    key_type: str
    allow_empty: bool = False


@dataclass(frozen=True)
class JobFilter:
    """Jobs to keep, per dimension; an empty list keeps all."""

    status: tuple[str, ...] = ("completed",)
    partition: tuple[str, ...] = ()
    user: tuple[str, ...] = ()
    group: tuple[str, ...] = ()
    account: tuple[str, ...] = ()

    def columns(self) -> dict[str, tuple[str, ...]]:
        """Wanted values per column of the dump, where any are configured."""
        wanted = {
            "State": self.status,
            "Partition": self.partition,
            "User": self.user,
            "Group": self.group,
            "Account": self.account,
        }
        return {name: values for name, values in wanted.items() if values}


@dataclass(frozen=True)
class SlurmConfig:
    record_prefix: str = "slurm"
    sites: tuple[SiteRule, ...] = (SiteRule("NOT_CONFIGURED"),)
    meta: tuple[MetaRule, ...] = ()
    components: tuple[ComponentRule, ...] = (ComponentRule("Cores", "NCPUS"),)
    job_filter: JobFilter = field(default_factory=JobFilter)
    timezone: str = "UTC"
    # A meta rule's guard is part of the configuration but has no effect
    # unless this is set.
    guard_meta: bool = False

    def types(self) -> dict[str, str]:
        """Type per key; of a key in two columns the later one counts."""
        return {key.name: key.key_type for key in self.keys()}

    def keys(self) -> list[Key]:
        """Columns of the dump in order; the first mention of a key decides its type."""
        found: dict[str, Key] = {}

        def add(name: str, key_type: str, allow_empty: bool = False) -> None:
            found.setdefault(name, Key(name, key_type, allow_empty))

        def add_guard(only_if: OnlyIf | None) -> None:
            if only_if is not None:
                add(only_if.key, "String")

        for site in self.sites:
            add_guard(site.only_if)
        for meta in self.meta:
            add(meta.key, meta.key_type, meta.allow_empty)
            add_guard(meta.only_if)
        for component in self.components:
            for score in component.scores:
                add_guard(score.only_if)
            add(component.key, component.key_type, component.allow_empty)
            add_guard(component.only_if)
        for name in self.job_filter.columns():
            if name not in dict(FIXED_KEYS):
                add(name, "String")
        keys = list(found.values())
        return keys + [Key(name, key_type) for name, key_type in FIXED_KEYS]


def parse_value(text: Column, key_type: str, timezone: str = "UTC") -> Column:
    parsers = {
        "Integer": parsing.integer,
        "IntegerMega": parsing.integer_mega,
        "Time": parsing.clock_seconds,
        "String": lambda value: value,
        "DateTime": lambda value: parsing.local_datetime(value, timezone),
        "Id": parsing.account_id,
        "Json": parsing.json_map,
    }
    return parsers[key_type](text)


def split_lines(lines: DataFrame, config: SlurmConfig) -> DataFrame:
    """``value`` lines -> one text column per key; short lines end in nulls and
    an empty cell is null unless its key may be empty."""
    cells = F.split("value", r"\|", -1)
    columns: dict[str, list[Column]] = {}
    for position, key in enumerate(config.keys()):
        cell = F.get(cells, F.lit(position))
        text = cell if key.allow_empty else F.nullif(cell, F.lit(""))
        # A key in two columns: the later one counts unless it is empty.
        columns.setdefault(key.name, []).insert(0, text)
    return lines.select(*[F.coalesce(*texts).alias(name) for name, texts in columns.items()])


def with_job(lines: DataFrame, config: SlurmConfig) -> DataFrame:
    """Job and batch lines with the id of their job; other lines are left out."""
    position = [key.name for key in config.keys()].index("JobID")
    cell = F.get(F.split("value", r"\|", -1), F.lit(position))
    is_batch = cell.rlike(BATCH_ID)
    return (
        lines.withColumn("cell", cell)
        .where((F.col("cell") != "") & (~F.col("cell").rlike(STEP_ID) | is_batch))
        .withColumn("job", F.regexp_replace("cell", r"\.batch$", ""))
        .withColumn("is_batch", F.col("cell").rlike(BATCH_ID))
        .drop("cell")
    )


def merge_steps(rows: DataFrame, config: SlurmConfig) -> DataFrame:
    """Text rows of jobs and steps -> one row of typed values per job.

    A value that the job line lacks, or that cannot be read there, comes from
    the job's batch step.  Values are read before the rows of a job meet in one
    aggregation, so every line is parsed and shuffled once.  If a line occurs
    twice, the last one counts.
    """
    types = config.types()
    typed = [
        parse_value(F.col(name), kind, config.timezone).alias(name) for name, kind in types.items()
    ]
    job_line = ~F.col("JobID").rlike(STEP_ID)
    batch_line = F.col("JobID").rlike(BATCH_ID)
    numbered = rows.where(F.col("JobID").isNotNull() & (job_line | batch_line)).select(
        F.regexp_replace("JobID", r"\.batch$", "").alias("job"),
        F.struct(*typed).alias("line"),
        F.when(job_line, F.monotonically_increasing_id()).alias("job_position"),
        F.when(batch_line, F.monotonically_increasing_id()).alias("batch_position"),
    )
    merged = (
        numbered.groupBy("job")
        .agg(
            F.max_by("line", "job_position").alias("main"),
            F.max_by("line", "batch_position").alias("batch"),
        )
        .where(F.col("main").isNotNull())
    )
    return merged.select(
        *[F.coalesce(F.col(f"main.{name}"), F.col(f"batch.{name}")).alias(name) for name in types]
    )


def started_or_kept(jobs: DataFrame) -> DataFrame:
    """Leave out jobs that were cancelled before they started."""
    never_started = F.col("State").startswith("CANCELLED") & F.col("Start").isNull()
    return jobs.where(~F.coalesce(never_started, F.lit(False)))


def filter_jobs(jobs: DataFrame, job_filter: JobFilter) -> DataFrame:
    """Status, partition, user, group and account filters.  A filter on a column that
    the dump does not have is an error."""
    for column, wanted in job_filter.columns().items():
        if column not in jobs.columns:
            raise ValueError(f"the dump has no column {column} to filter by")
        if column == "State":
            # "CANCELLED by 1000" is a CANCELLED job.
            state = F.lower(F.substring_index("State", " ", 1))
            jobs = jobs.where(state.isin(*[status.lower() for status in wanted]))
        else:
            jobs = jobs.where(F.col(column).isin(*wanted))
    return jobs


def _text_of(name: str) -> Column:
    return F.col(name).cast("string")


def as_text(value: Column, kind: str) -> Column:
    """A parsed value as it stands in the metadata."""
    if kind == "DateTime":
        value = F.date_format(value, "yyyy-MM-dd HH:mm:ss 'UTC'")
    return value.cast("string")


def _meta(config: SlurmConfig) -> Column:
    typed = F.create_map().cast("map<string,array<string>>")
    for rule in config.meta:
        value, kind = F.col(rule.key), config.types()[rule.key]
        if kind == "Json":
            entry = F.transform_values(
                F.coalesce(value, F.create_map().cast("map<string,string>")),
                lambda _, v: F.array(v),
            )
        else:
            entry = F.when(
                value.isNotNull(),
                F.create_map(F.lit(rule.name), F.array(as_text(value, kind))),
            ).otherwise(F.create_map().cast("map<string,array<string>>"))
        if config.guard_meta:
            entry = F.when(guard(rule.only_if, _text_of), entry).otherwise(
                F.create_map().cast("map<string,array<string>>")
            )
        typed = merge_maps(typed, entry)
    fixed = F.create_map(
        F.lit("site_id"), F.array("site"),
        F.lit("user_id"), F.array("User"),
        F.lit("group_id"), F.array("Group"),
    )
    return merge_maps(typed, fixed)


def to_records(jobs: DataFrame, config: SlurmConfig) -> DataFrame:
    """Jobs -> records to add.  A job is left out if no site rule applies, a
    component has neither value nor default, or start, end, user or group is
    missing."""
    def amount_of(rule: ComponentRule) -> Column:
        return F.col(rule.key).cast("bigint")

    components, complete = components_of(config.components, amount_of, _text_of)
    placed = jobs.withColumn("site", first_site(config.sites, _text_of))
    needed = F.col("site").isNotNull() & complete
    for name in ("Start", "End", "User", "Group"):
        needed &= F.col(name).isNotNull()
    return placed.where(needed).select(
        record_key(config.record_prefix, F.col("JobID")).alias("record_id"),
        _meta(config).alias("meta"),
        components.alias("components"),
        F.col("Start").alias("start_time"),
        F.col("End").alias("stop_time"),
    )


def collect(lines: DataFrame, config: SlurmConfig) -> DataFrame:
    """Dump lines -> records to add."""
    jobs = started_or_kept(merge_steps(split_lines(lines, config), config))
    return to_records(filter_jobs(jobs, config.job_filter), config)


def next_mark(
    records: DataFrame, last_check: datetime | None = None, last_id: str | None = None
) -> DataFrame:
    """Latest stop time and its record; the old mark if there are no records."""
    return records.agg(
        F.max("stop_time").alias("stop"),
        F.max_by("record_id", F.struct("stop_time", "record_id")).alias("id"),
    ).select(
        F.coalesce("stop", F.lit(last_check).cast("timestamp")).alias("last_check"),
        F.coalesce("id", F.lit(last_id).cast("string")).alias("last_id"),
    )
