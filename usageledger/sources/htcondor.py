"""Job history of HTCondor: comma-separated class-ad values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.functions.parsing import integer, loose_amount, loose_text
from usageledger.functions.records import record_key
from usageledger.schema import COMPONENT_DDL, SCORES_DDL
from usageledger.sources.rules import OnlyIf

UNDEFINED = "undefined"
# Where a job's times come from, in order.
START_ADS = ("LastMatchTime",)
STOP_ADS = ("CompletionDate", "EpochWriteDate", "EnteredCurrentStatus")


@dataclass(frozen=True)
class Getter:
    """How to get one value out of a job: from an ad (``key``), else a constant
    ``factor``, else the ``name``; ``matches`` cuts out the pattern's first
    group, or stands for the name if it has none."""

    name: str | None = None
    key: str | None = None
    factor: float | int | None = None
    matches: str | None = None
    only_if: OnlyIf | None = None


@dataclass(frozen=True)
class CondorComponent:
    getter: Getter
    scores: tuple[Getter, ...] = field(default_factory=tuple)

    @property
    def name(self) -> str:
        return self.getter.name


@dataclass(frozen=True)
class CondorConfig:
    class_ads: Sequence[str]
    meta: Mapping[str, Sequence[Getter]]
    components: Sequence[CondorComponent]
    record_prefix: str = "htcondor"
    job_status: Sequence[int] = ()
    since: int | None = None
    # A condition in SQL over the class ads, which are text; null means no.
    constraint: str | None = None


def split_history(lines: DataFrame, config: CondorConfig) -> DataFrame:
    """``value`` lines -> one stripped text column per class ad; an undefined ad
    is null.

    The cells leave as one generated row, so that conditions on them further up
    do not repeat the splitting.
    """
    cells = F.transform(
        F.split("value", ",", -1), lambda cell: F.nullif(F.trim(cell), F.lit(UNDEFINED))
    )
    ads = [F.get("cells", F.lit(at)).alias(ad) for at, ad in enumerate(config.class_ads)]
    others = [name for name in lines.columns if name != "value"]
    rows = lines.where(F.trim("value") != "").select(*others, cells.alias("cells"))
    return rows.select(*others, F.inline(F.array(F.struct(*ads))))


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def value_of(getter: Getter, ads: Sequence[str]) -> Column:
    """A configured value as text; null if it cannot be had."""
    if getter.key is not None:
        if getter.key not in ads:
            return F.lit(None).cast("string")
        value = F.col(getter.key)
    elif getter.factor is not None:
        value = F.lit(str(getter.factor))
    else:
        value = F.lit(getter.name).cast("string")
    if getter.matches is not None:
        if _groups(getter.matches) > 0:
            found = F.regexp_extract_all(value, F.lit(getter.matches), F.lit(1))
            value = F.get(found, F.lit(0))
        else:
            value = F.when(value.rlike(getter.matches), F.lit(getter.name))
    elif getter.key is not None:
        value = loose_text(value)
    if getter.only_if is not None:
        value = F.when(F.col(getter.only_if.key).rlike(getter.only_if.matches), value)
    return value


def meta_of(config: CondorConfig) -> Column:
    """Value lists per key: all values that are there; for ``site`` the first."""
    entries = []
    for key, getters in config.meta.items():
        values = [value_of(getter, config.class_ads) for getter in getters]
        found = F.array_compact(F.array(*values))
        if key == "site":
            found = F.slice(found, 1, 1)
        entries.append(F.struct(F.lit(key).alias("key"), found.alias("value")))
    if not entries:
        return F.create_map().cast("map<string,array<string>>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def _amount(getter: Getter, ads: Sequence[str]) -> Column:
    if getter.matches is not None:
        return integer(value_of(getter, ads))
    raw = Getter(getter.name, getter.key, getter.factor, None, getter.only_if)
    if getter.key is None or getter.key not in ads:
        return loose_amount(value_of(raw, ads))
    amount = loose_amount(F.col(getter.key))
    if getter.only_if is not None:
        amount = F.when(F.col(getter.only_if.key).rlike(getter.only_if.matches), amount)
    return amount


def score_of(text: Column) -> Column:
    """A score out of a configured value: zero if missing, null if no number."""
    number = F.coalesce(
        text.try_cast("double"), F.when(text == "True", 1.0).when(text == "False", 0.0)
    )
    return F.when(text.isNull() | (text == ""), F.lit(0.0)).otherwise(number)


def _scores(component: CondorComponent, index: int) -> list[tuple[str, Getter]]:
    """Working column per score of a component."""
    return [(f"score_{index}_{at}", getter) for at, getter in enumerate(component.scores)]


def _first_time(names: Sequence[str], ads: Sequence[str], skip_zero: bool) -> Column:
    times = []
    for ad in names:
        if ad in ads:
            seconds = F.col(ad).try_cast("double")
            times.append(F.nullif(seconds, F.lit(0.0)) if skip_zero else seconds)
    return F.coalesce(*times) if times else F.lit(None).cast("double")


def filter_history(jobs: DataFrame, config: CondorConfig) -> DataFrame:
    """Wanted job states, jobs completed after the given time, and the constraint."""
    if config.job_status:
        jobs = jobs.where(
            F.col("JobStatus").try_cast("int").isin(*[int(s) for s in config.job_status])
        )
    if config.since is not None:
        completed = F.col("CompletionDate").try_cast("double")
        jobs = jobs.where((completed > config.since) & (completed > 0))
    if config.constraint is not None:
        jobs = jobs.where(F.expr(config.constraint))
    return jobs


def after_marks(jobs: DataFrame, marks: DataFrame, schedd: str = "schedd") -> DataFrame:
    """Jobs behind the last one known of their scheduler (``next_marks``, one row per
    scheduler); all jobs of a scheduler without a mark."""
    known = marks.select(schedd, F.struct("cluster", "proc").alias("mark"))
    job = F.struct(
        F.col("ClusterId").try_cast("bigint").alias("cluster"),
        F.col("ProcId").try_cast("bigint").alias("proc"),
    )
    behind = F.col("mark").isNull() | (job > F.col("mark"))
    return jobs.join(known, schedd, "left").where(behind).drop("mark")


def to_records(jobs: DataFrame, config: CondorConfig) -> DataFrame:
    """Jobs -> records to add, plus ``has_stop``: a job without any stop time
    ends at the epoch.

    A job without a start, or with one amount or score that is no number, yields
    no record.
    """
    start = _first_time(START_ADS, config.class_ads, skip_zero=False)
    stop = _first_time(STOP_ADS, config.class_ads, skip_zero=True)
    work = {"start": start, "stop": stop, "meta": meta_of(config)}
    entries, needed = [], ["start"]
    for index, component in enumerate(config.components):
        work[f"amount_{index}"] = _amount(component.getter, config.class_ads)
        scores = []
        for column, getter in _scores(component, index):
            work[column] = score_of(value_of(getter, config.class_ads))
            needed.append(column)
            scores.append(
                F.struct(F.lit(getter.name).alias("name"), F.col(column).alias("value"))
            )
        needed.append(f"amount_{index}")
        entries.append(
            F.struct(
                F.lit(component.name).alias("name"),
                F.col(f"amount_{index}").alias("amount"),
                (F.array(*scores) if scores else F.array()).cast(SCORES_DDL).alias("scores"),
            )
        )
    record = F.struct(
        record_key(config.record_prefix, F.col("GlobalJobId")).alias("record_id"),
        F.col("meta").alias("meta"),
        F.array(*entries).cast(f"array<{COMPONENT_DDL}>").alias("components"),
        F.timestamp_seconds("start").alias("start_time"),
        F.timestamp_seconds(F.coalesce("stop", F.lit(0.0))).alias("stop_time"),
        F.col("stop").isNotNull().alias("has_stop"),
    )
    complete = F.lit(True)
    for column in needed:
        complete &= F.col(column).isNotNull()
    # Every value is computed once, as a column; the record then leaves as zero
    # or one generated row.
    computed = jobs.select("GlobalJobId", *[value.alias(name) for name, value in work.items()])
    return computed.select(F.inline(F.filter(F.array(record), lambda _: complete)))


def collect(lines: DataFrame, config: CondorConfig) -> DataFrame:
    return to_records(filter_history(split_history(lines, config), config), config)


def next_marks(jobs: DataFrame, schedd: str = "schedd") -> DataFrame:
    """Last job (cluster, proc) per scheduler."""
    job = F.struct(
        F.col("ClusterId").try_cast("bigint").alias("cluster"),
        F.col("ProcId").try_cast("bigint").alias("proc"),
    )
    return (
        jobs.groupBy(schedd).agg(F.max(job).alias("last")).select(schedd, "last.cluster", "last.proc")
    )
