"""Records from files: JSON, archives, samples, flat legacy tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from usageledger.operators.reshape import from_flat_tables
from usageledger.operators.validity import split_valid
from usageledger.plans.archive import decode_archive, read_archive
from usageledger.plans.enrichment import SAMPLES
from usageledger.schema import RECORD, RECORD_ADD, RECORD_COLUMNS

FLAT_TABLES = (
    "accounting", "meta", "components", "scores", "components_scores", "records_components",
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records in query form, as Parquet."""
    return spark.read.schema(RECORD).parquet(path).select(*RECORD_COLUMNS)


def read_json(
    spark: SparkSession, path: str, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Records to add: one object per line, or with ``multi_line`` one object or
    array per file.  Returns (valid, rejects with reasons)."""
    added = spark.read.schema(RECORD_ADD).option("multiLine", multi_line).json(path)
    return split_valid(added)


def read_archived(spark: SparkSession, path: str) -> DataFrame:
    return decode_archive(read_archive(spark, path))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).parquet(path)


def read_flat(spark: SparkSession, folder: str) -> DataFrame:
    """Records out of the six flat tables below a folder."""
    tables: Mapping[str, DataFrame] = {
        name: spark.read.parquet(f"{folder}/{name}") for name in FLAT_TABLES
    }
    return from_flat_tables(dict(tables))
