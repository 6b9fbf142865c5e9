"""The ids of a record store in hash buckets.

A lookup reads only the buckets that its ids fall into, and of those only ids and
months.  The index is a log: a row says that an id has been there, or gone, since a
version; the newest one counts.  New rows go to a new segment.  When segments of
similar size pile up they are merged, so a store has few segments, and a row is
written again only when its segment has at least doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageledger.operators.lookup import BROADCAST_ROWS
from usageledger.plans.manifest import IndexSegment
from usageledger.schema import INDEXED, no_rows


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int")


def write(rows: DataFrame, path: str, segment: int, buckets: int) -> None:
    """Write record_id, start_month, live and since as a segment."""
    (
        rows.select("record_id", "start_month", "live", "since", bucket(buckets).alias("bucket"))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "record_id")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{path}/ids/segment={segment}")
    )


def read(spark: SparkSession, path: str, segments: list[IndexSegment]) -> DataFrame:
    if not segments:
        return no_rows(spark, INDEXED)
    folders = [f"{path}/ids/segment={s.segment}" for s in segments]
    return spark.read.schema(INDEXED).option("basePath", f"{path}/ids").parquet(*folders)


def lookup(index: DataFrame, ids: DataFrame, buckets: int) -> DataFrame:
    """record_id and start_month of those ids that are there.

    The buckets of the ids with their numbers of ids, at most ``buckets`` rows, come to the
    driver, so that the others are not opened, and many ids are not broadcast.
    """
    wanted = ids.select("record_id")
    touched = wanted.groupBy(bucket(buckets).alias("bucket")).count().collect()
    if len(touched) < buckets:
        index = index.where(F.col("bucket").isin(*(row["bucket"] for row in touched)) if touched else F.lit(False))
    size = sum(row["count"] for row in touched)
    there = newest(index.join(by_size(wanted, size), "record_id", "left_semi")).where("live")
    return by_size(there.select("record_id", "start_month"), size)


def by_size(side: DataFrame, rows: int) -> DataFrame:
    """One side of a join with a known number of rows, or a bound of it: more than
    ``BROADCAST_ROWS`` are never sent to the driver, however small their files are."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side.hint("merge")


def newest(index: DataFrame) -> DataFrame:
    """The newest row of each id."""
    latest = F.max_by(F.struct("start_month", "live", "since"), "since")
    return index.groupBy("record_id").agg(latest.alias("row")).select("record_id", "row.*")
