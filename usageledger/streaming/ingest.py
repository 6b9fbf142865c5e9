"""Continuous ingest into the record store.

The stream's checkpoint remembers which files were read, and the store skips
records it has, so a batch that runs again after a failure changes nothing.
There is no watermark: a late job is never dropped.  What the store rejects is kept
in a table beside the checkpoint, one folder per batch; ``rejected`` reads it.

State that lives from batch to batch has one version per batch, made from the
version before; two versions are kept.  A new checkpoint counts on from the newest
version, so nothing that waits is forgotten.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from usageledger.operators.query import time_literal
from usageledger.plans.files import partition_folders, remove_folder
from usageledger.plans.store import RecordStore
from usageledger.schema import RECORD_ADD, no_rows
from usageledger.sources import htcondor, slurm
from usageledger.sources.kubernetes import POD

# A delivery of a client: a record to add, or a stop time to set.
MESSAGE = T.StructType([T.StructField("kind", T.StringType()), *RECORD_ADD.fields])
INSERT, UPDATE = "insert", "update"


def text_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    return _limited(spark, files_per_batch).text(folder)


def pod_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    return _limited(spark, files_per_batch).schema(POD).json(folder)


def parquet_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    return _limited(spark, files_per_batch).schema(schema).parquet(folder)


def _limited(spark: SparkSession, files_per_batch: int | None):
    reader = spark.readStream
    return reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)


def start(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Run a batch function; without an interval take what is there and stop."""
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def not_before(last: datetime | None, earliest: datetime) -> datetime:
    """Mark to read from: the last one, but never before the earliest time."""
    return earliest if last is None else max(last, earliest)


def keep_rejects(rejects: DataFrame, checkpoint: str, batch_id: int) -> None:
    target = f"{checkpoint.rstrip('/')}-rejected/batch={batch_id}"
    rejects.write.mode("overwrite").parquet(target)


def rejected(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The records that the store refused, with their reasons and their batch."""
    return spark.read.parquet(f"{checkpoint.rstrip('/')}-rejected")


def ingest(
    stream: DataFrame,
    to_records: Callable[[DataFrame], DataFrame],
    store: RecordStore,
    checkpoint: str,
    interval: str | None = None,
    earliest: datetime | None = None,
) -> StreamingQuery:
    """Scheduler output -> records -> store."""

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        records = to_records(batch)
        if earliest is not None:
            bound = time_literal(earliest, records.schema["stop_time"].dataType)
            records = records.where(F.col("stop_time") > bound)
        keep_rejects(store.add(records, on_duplicate="skip", on_invalid="skip"), checkpoint, batch_id)

    return start(stream, each_batch, checkpoint, interval)


LINES = T.StructType([T.StructField("value", T.StringType()), T.StructField("since", T.LongType())])


def ingest_jobs(
    stream: DataFrame,
    config: slurm.SlurmConfig,
    store: RecordStore,
    pending_path: str,
    checkpoint: str,
    patience: int = 10,
    interval: str | None = None,
) -> StreamingQuery:
    """Slurm dump lines -> store, where the lines of a job may come in any batch.

    A job is stored when its own line and its batch line are there, or when its
    first line has waited for ``patience`` batches; ``flush_jobs`` ends the wait
    without new input.  A batch line that comes later still has no effect.
    """
    spark = store.spark
    offset = _version_offset(spark, pending_path, checkpoint)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        version = offset + batch_id
        lines = batch.select("value", F.lit(version).cast("long").alias("since"))
        before = _version_before(spark, pending_path, version)
        if before is not None:
            lines = lines.unionByName(spark.read.schema(LINES).parquet(before))
        rejects = _store_jobs(lines, config, store, pending_path, version, version - patience)
        keep_rejects(rejects, checkpoint, batch_id)

    return start(stream, each_batch, checkpoint, interval)


def flush_jobs(config: slurm.SlurmConfig, store: RecordStore, pending_path: str) -> DataFrame:
    """Store all jobs that wait, complete or not; for use between two runs of the
    stream.  Returns the rejected records."""
    spark = store.spark
    newest = _version_before(spark, pending_path, 2**62)
    if newest is None:
        return no_rows(spark, RECORD_ADD)
    lines = spark.read.schema(LINES).parquet(newest)
    version = int(newest.rsplit("=", 1)[1])
    return _store_jobs(lines, config, store, pending_path, version, 2**62)


def _store_jobs(
    lines: DataFrame, config: slurm.SlurmConfig, store: RecordStore, path: str, version: int, due: int
) -> DataFrame:
    """Store what is complete or has waited since ``due``; the rest is the new version."""
    spark = store.spark
    keyed = slurm.with_job(lines, config)
    jobs = keyed.groupBy("job").agg(
        F.bool_or("is_batch").alias("has_batch"),
        F.bool_or(~F.col("is_batch")).alias("has_job"),
        F.min("since").alias("first"),
    )
    ready = (F.col("has_batch") & F.col("has_job")) | (F.col("first") <= due)
    # Written once, read twice: what to store and what waits.
    tried = f"{path}-tried/batch={version}"
    # A job has a few lines, so there are about as many jobs as lines: never broadcast.
    keyed.join(jobs.hint("merge"), "job").select("value", "since", ready.alias("ready")).write.mode("overwrite").parquet(tried)
    state = spark.read.parquet(tried)
    records = slurm.collect(state.where("ready").select("value"), config)
    rejects = store.add(records, on_duplicate="skip", on_invalid="skip")
    _write_version(state.where("NOT ready").select("value", "since"), path, version)
    return rejects


MARKS = T.StructType(
    [
        T.StructField("schedd", T.StringType()),
        T.StructField("cluster", T.LongType()),
        T.StructField("proc", T.LongType()),
    ]
)


def ingest_history(
    stream: DataFrame,
    config: htcondor.CondorConfig,
    store: RecordStore,
    marks_path: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """HTCondor history -> records -> store, behind the mark of each scheduler.

    A mark is the last job (cluster, proc) that a scheduler has given.  A batch takes the
    jobs behind the marks of the batch before, so history that is read again adds no
    work, and leaves the marks after it as a new version.  A scheduler gives its
    jobs in order from batch to batch; inside a batch they may come in any order.
    A job below the mark is taken for one that was read.
    """
    spark = store.spark
    offset = _version_offset(spark, marks_path, checkpoint)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        version = offset + batch_id
        marks = _marks_at(spark, _version_before(spark, marks_path, version))
        jobs = htcondor.after_marks(htcondor.split_history(batch, config), marks)
        records = htcondor.to_records(htcondor.filter_history(jobs, config), config).drop("has_stop")
        rejects = store.add(records, on_duplicate="skip", on_invalid="skip")
        keep_rejects(rejects, checkpoint, batch_id)
        last = F.max(F.struct("cluster", "proc")).alias("last")
        reached = marks.unionByName(htcondor.next_marks(jobs)).groupBy("schedd").agg(last)
        _write_version(reached.select("schedd", "last.cluster", "last.proc"), marks_path, version)

    return start(stream, each_batch, checkpoint, interval)


def marks(spark: SparkSession, marks_path: str) -> DataFrame:
    """The last job of each scheduler."""
    return _marks_at(spark, _version_before(spark, marks_path, 2**62))


def _marks_at(spark: SparkSession, folder: str | None) -> DataFrame:
    return no_rows(spark, MARKS) if folder is None else spark.read.schema(MARKS).parquet(folder)


def deliver(
    messages: DataFrame,
    store: RecordStore,
    pending_path: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Store-and-forward delivery: inserts first, then updates.

    A record that exists counts as delivered.  An update whose record is not
    there yet waits for the next batch.
    """
    offset = _version_offset(store.spark, pending_path, checkpoint)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        version = offset + batch_id
        # The batch is read once for its inserts and once for its updates.
        inserts = batch.where(F.col("kind") == INSERT).drop("kind")
        rejects = store.add(inserts, on_duplicate="skip", on_invalid="skip")
        keep_rejects(rejects, checkpoint, batch_id)
        updates = batch.where(F.col("kind") == UPDATE).select(
            "record_id", "stop_time", F.lit(version).alias("batch_id")
        )
        before = _version_before(store.spark, pending_path, version)
        if before is not None:
            updates = updates.unionByName(store.spark.read.parquet(before).select(updates.columns))
        _apply_updates(updates, store, pending_path, version)

    return start(messages, each_batch, checkpoint, interval)


def deliver_waiting(store: RecordStore, pending_path: str) -> None:
    """Try the updates that wait once more, without new messages; for use between two
    runs of the stream."""
    newest = _version_before(store.spark, pending_path, 2**62)
    if newest is not None:
        version = int(newest.rsplit("=", 1)[1])
        updates = store.spark.read.parquet(newest).select("record_id", "stop_time", "batch_id")
        _apply_updates(updates, store, pending_path, version)


def _apply_updates(updates: DataFrame, store: RecordStore, path: str, version: int) -> None:
    tried = f"{path}-tried/batch={version}"
    _last_update(updates).write.mode("overwrite").parquet(tried)
    unknown = store.update(store.spark.read.parquet(tried), order_by="batch_id", on_unknown="return")
    _write_version(unknown.withColumn("batch_id", F.lit(version)), path, version)


def _last_update(updates: DataFrame) -> DataFrame:
    order: Column = F.struct("batch_id", "stop_time")
    return updates.groupBy("record_id").agg(
        F.max_by("stop_time", order).alias("stop_time"), F.max("batch_id").alias("batch_id")
    )


def _write_version(state: DataFrame, path: str, version: int) -> None:
    """Write the state after a batch and forget what no batch can need any more: the
    checkpoint has passed all batches before this one, and this one, if it runs again,
    starts from the version before."""
    state.write.mode("overwrite").parquet(f"{path}/batch={version}")
    spark = state.sparkSession
    for folder in (path, f"{path}-tried"):
        for name in partition_folders(spark, folder):
            if int(name.split("=")[1]) < version - 1:
                remove_folder(spark, f"{folder}/{name}")


def _version_offset(spark: SparkSession, path: str, checkpoint: str) -> int:
    """What to add to a batch number to get its version.  A new checkpoint starts
    behind the newest version; it remembers the offset for its next runs."""
    marker = f"{checkpoint.rstrip('/')}-offset"
    try:
        return spark.read.schema("first long").parquet(marker).first()["first"]
    except AnalysisException:
        versions = [int(name.split("=")[1]) for name in partition_folders(spark, path)]
        first = max(versions, default=-1) + 1
        spark.range(first, first + 1).select(F.col("id").alias("first")).write.parquet(marker)
        return first


def _version_before(spark: SparkSession, path: str, batch_id: int) -> str | None:
    """Folder of the newest version older than the batch."""
    versions = [int(name.split("=")[1]) for name in partition_folders(spark, path)]
    older = [version for version in versions if version < batch_id]
    return f"{path}/batch={max(older)}" if older else None
