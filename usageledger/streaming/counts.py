"""Continuous counts; the state is one number per label value or day."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usageledger.plans.metrics import label_counts


def daily_counts(records: DataFrame) -> DataFrame:
    """Records per day of their stop time, for a batch or a stream."""
    day = F.window(F.col("stop_time").cast("timestamp"), "1 day")
    return (
        records.where(F.col("stop_time").isNotNull())
        .groupBy(day.alias("window"))
        .agg(F.count("*").alias("num"), F.sum("runtime").alias("runtime"))
        .select(F.col("window.start").cast("date").alias("day"), "num", "runtime")
    )


def keep_table(
    counts: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Replace the table at ``path`` by the current counts after every batch."""

    def each_batch(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def count_metrics(
    records: DataFrame,
    keys: Mapping[str, str],
    path: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Counts per label value, refreshed at every trigger."""
    return keep_table(label_counts(records, keys), path, checkpoint, interval)
