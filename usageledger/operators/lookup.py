"""Joins against small configured tables, and the label match join."""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageledger.session import materialize

# A lookup that comes out of a configuration is broadcast up to this many rows;
# a longer one is joined like any other table.
BROADCAST_ROWS = 100_000
# Configured ids that are part of the plan as a literal; more would make plans slow.
LITERAL_IDS = 10_000


def lookup_table(
    spark: SparkSession,
    entries: Mapping[str, Any],
    key: str,
    value: str,
    value_type: T.DataType,
) -> DataFrame:
    """A configured mapping as a table of (key, value)."""
    schema = T.StructType(
        [T.StructField(key, T.StringType(), False), T.StructField(value, value_type)]
    )
    table = spark.createDataFrame(list(entries.items()), schema)
    return F.broadcast(table) if len(entries) <= BROADCAST_ROWS else table


def watt_per_core(df: DataFrame, watts: Mapping[str, float] | float, site: str = "site") -> DataFrame:
    """Add ``watt_per_core``: per site (null for an unknown one) or one default."""
    if not isinstance(watts, Mapping):
        return df.withColumn("watt_per_core", F.lit(float(watts)))
    table = lookup_table(
        df.sparkSession,
        {key: float(value) for key, value in watts.items()},
        site,
        "watt_per_core",
        T.DoubleType(),
    )
    return df.join(table, site, "left")


def site_ids(meta_keys: Sequence[str]) -> Column:
    """All site ids a record carries under any of the keys, with repetition."""
    lists = [
        F.coalesce(F.try_element_at("meta", F.lit(key)), F.array().cast("array<string>"))
        for key in meta_keys
    ]
    return F.concat(*lists)


def assign_report_sites(
    records: DataFrame,
    sites: Mapping[str, Sequence[str]],
    meta_keys: Sequence[str],
    check_duplicates: bool = False,
    literal_ids: int = LITERAL_IDS,
) -> DataFrame:
    """One row per record and report site that one of its site ids belongs to.

    A record that carries several ids of one report site appears once; with
    ``check_duplicates`` such a record fails the job instead.  Rows stay apart, also
    rows with equal ids.

    Up to ``literal_ids`` configured ids are a literal: a list of small maps, chosen by
    the hash of an id, so a lookup costs the same however many are configured, and
    rows are mapped in place without a shuffle.  More ids than that are a table:
    the ids of the rows, under the number of their row, are joined with it.
    """
    by_id: dict[str, list[str]] = {}
    for site, its_ids in sites.items():
        for site_id in dict.fromkeys(its_ids):
            by_id.setdefault(site_id, []).append(site)
    ids = site_ids(meta_keys)
    if len(by_id) <= literal_ids:
        # An id that occurs twice in a row is found twice.
        found = _found_in_literal(ids, by_id)
    else:
        records, found = _found_by_join(records, ids, by_id)
    distinct = F.array_distinct(found)
    if check_duplicates:
        distinct = F.when(F.size(found) == F.size(distinct), distinct).otherwise(
            F.raise_error(
                F.concat(
                    F.lit("reported twice for site "),
                    F.get(F.filter(distinct, lambda s: F.size(F.filter(found, lambda f: f == s)) > 1), F.lit(0)),
                    F.lit(": "),
                    F.col("record_id"),
                )
            ).cast("array<string>")
        )
    return records.withColumn("report_site", F.explode(distinct)).drop("_sites")


_IDS_PER_MAP = 4


def _found_in_literal(ids: Column, by_id: Mapping[str, Sequence[str]]) -> Column:
    """The sites of each id, in order, from small maps by the id's checksum."""
    none = F.array().cast("array<string>")
    if not by_id:
        return none
    size = max(1, len(by_id) // _IDS_PER_MAP)
    maps: list[dict[str, list[str]]] = [{} for _ in range(size)]
    for site_id, names in by_id.items():
        maps[zlib.crc32(site_id.encode()) % size][site_id] = list(names)
    kind = T.ArrayType(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    literal = F.from_json(F.lit(json.dumps(maps)), kind)

    def sites_of(site_id: Column) -> Column:
        place = (F.crc32(site_id.cast("binary")) % size).cast("int")
        return F.coalesce(F.try_element_at(F.get(literal, place), site_id), none)

    return F.flatten(F.transform(ids, sites_of))


def _found_by_join(
    records: DataFrame, ids: Column, by_id: Mapping[str, Sequence[str]]
) -> tuple[DataFrame, Column]:
    """Records with the sites of their ids in a column, by a join on the ids.  A site
    id that a third of the rows carry is split by the rule for skewed joins; the
    grouping is by row."""
    spark = records.sparkSession
    rows = materialize(records.withColumn("_row", F.monotonically_increasing_id()), "sited-records")
    table = spark.createDataFrame(
        [(site_id, list(names)) for site_id, names in by_id.items()], "site_id string, sites array<string>"
    )
    found = (
        rows.select("_row", F.posexplode(ids).alias("_at", "site_id"))
        .join(table, "site_id")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "sites"))).alias("hits"))
        .select("_row", F.flatten(F.transform("hits", lambda hit: hit["sites"])).alias("_sites"))
    )
    return rows.join(found, "_row").drop("_row"), F.col("_sites")
