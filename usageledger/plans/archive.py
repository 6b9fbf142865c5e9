"""Monthly archive: write old months, check them, delete, restore."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageledger.functions.calendar import archive_cutoff
from usageledger.operators.query import time_literal
from usageledger.plans.files import partition_folders
from usageledger.plans.store import RecordStore
from usageledger.schema import COMPONENTS_DDL, META_DDL
from usageledger.session import settings

COMPRESSIONS = ("gzip", "snappy")


class ArchiveExists(ValueError):
    """A month is in the archive already."""


class ArchiveMismatch(ValueError):
    """The archive does not hold what the store has for a month."""


def oldest_stop(records: DataFrame) -> DataFrame:
    return records.agg(F.min("stop_time").alias("oldest_stop"))


def old_enough(records: DataFrame, now: datetime, older_than_months: int) -> DataFrame:
    """Closed records of all complete months before the cutoff."""
    cutoff = archive_cutoff(now, older_than_months)
    return records.where(
        F.col("stop_time") < time_literal(cutoff, records.schema["stop_time"].dataType)
    )


def as_text(nested: str) -> Column:
    """JSON text; a missing value is the text ``null``."""
    return F.coalesce(F.to_json(nested), F.lit("null"))


def to_archive_rows(records: DataFrame) -> DataFrame:
    return records.select(
        "record_id",
        as_text("meta").alias("meta"),
        as_text("components").alias("components"),
        F.date_trunc("millisecond", F.col("start_time").cast("timestamp")).alias("start_time"),
        F.date_trunc("millisecond", F.col("stop_time").cast("timestamp")).alias("stop_time"),
        "runtime",
        F.year("stop_time").alias("year"),
        F.month("stop_time").alias("month"),
    )


def write_archive(
    records: DataFrame,
    path: str,
    now: datetime,
    older_than_months: int,
    compression: str = "gzip",
) -> DataFrame:
    """Write every month that is old enough below ``year=/month=`` and return
    the rows per month.  A month that exists in the archive stops the job."""
    if compression not in COMPRESSIONS:
        raise ValueError(f"unknown compression {compression!r}; one of {COMPRESSIONS}")
    spark = records.sparkSession
    rows = to_archive_rows(old_enough(records, now, older_than_months))
    present = archived_months(spark, path)
    again = sorted(present & set(months_of(rows))) if present else []
    if again:
        raise ArchiveExists(f"archived before: {again}")
    with settings(spark, spark__sql__parquet__outputTimestampType="TIMESTAMP_MILLIS"):
        (
            # Splits a month that is large and merges months that are small.
            rows.hint("rebalance", "year", "month")
            .sortWithinPartitions("year", "month", "record_id")
            .write.mode("append")
            .partitionBy("year", "month")
            .option("compression", compression)
            .parquet(path)
        )
    return rows.groupBy("year", "month").count()


def months_of(rows: DataFrame) -> list[tuple[int, int]]:
    """The calendar months in rows with ``year`` and ``month``; a short list
    whatever the number of rows."""
    found = rows.select("year", "month").distinct().collect()
    return sorted((row["year"], row["month"]) for row in found)


def archived_months(spark: SparkSession, path: str) -> set[tuple[int, int]]:
    """Months the archive has, from its folder names."""
    months = set()
    for year in partition_folders(spark, path):
        for month in partition_folders(spark, f"{path}/{year}"):
            months.add((int(year.split("=")[1]), int(month.split("=")[1])))
    return months


def in_months(months: list[tuple[int, int]]) -> Column:
    """Condition on the partition columns, so other months are not read."""
    wanted = F.lit(False)
    for year, month in months:
        wanted |= (F.col("year") == year) & (F.col("month") == month)
    return wanted


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived rows with year and month, nested parts still as text."""
    return spark.read.parquet(path)


def decode_archive(archived: DataFrame) -> DataFrame:
    """Archived rows -> records; text that cannot be read becomes null."""
    return archived.select(
        "record_id",
        F.from_json("meta", META_DDL).alias("meta"),
        F.from_json("components", COMPONENTS_DDL).alias("components"),
        "start_time",
        "stop_time",
        "runtime",
    )


def month_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(
        F.year("stop_time").alias("year"), F.month("stop_time").alias("month")
    ).agg(F.count("*").alias("num"))


def mismatches(records: DataFrame, archived: DataFrame) -> DataFrame:
    """Months in which the store's records and the archive differ in their
    number of rows."""
    stored = month_counts(records).withColumnRenamed("num", "stored")
    kept = archived.groupBy("year", "month").agg(F.count("*").alias("archived"))
    none = F.lit(0).cast("bigint")
    return (
        kept.join(stored, ["year", "month"], "full")
        .withColumns(
            {"stored": F.coalesce("stored", none), "archived": F.coalesce("archived", none)}
        )
        .where(F.col("archived") != F.col("stored"))
    )


def archive_store(
    store: RecordStore,
    path: str,
    now: datetime,
    older_than_months: int,
    compression: str = "gzip",
) -> None:
    """Archive, check, and only then delete what was archived.  Reads the months that
    hold records which stopped before the cutoff."""
    moving = store.stopped_before(archive_cutoff(now, older_than_months))
    months = months_of(to_archive_rows(moving))
    if not months:
        return
    write_archive(moving, path, now, older_than_months, compression)
    archived = read_archive(store.spark, path).where(in_months(months))
    wrong = mismatches(moving, archived).take(1)
    if wrong:
        raise ArchiveMismatch(f"month {wrong[0]['year']}-{wrong[0]['month']:02d}: {wrong[0]}")
    store.delete(archived.select("record_id"))


def restore(
    store: RecordStore, path: str, months: list[tuple[int, int]] | None = None,
    on_duplicate: str = "error", on_invalid: str = "error",
) -> DataFrame:
    """Put archived months back; all or nothing by default, or leaving out what
    exists or is invalid.  Returns the rejects."""
    archived = read_archive(store.spark, path)
    if months is not None:
        archived = archived.where(in_months(months))
    records = decode_archive(archived).withColumn(
        "components",
        F.coalesce("components", F.array().cast(COMPONENTS_DDL)),
    )
    return store.add(records, on_duplicate, on_invalid)
