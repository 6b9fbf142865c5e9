"""Enrichment of pod records as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usageledger.plans import enrichment
from usageledger.plans.store import RecordStore
from usageledger.schema import no_rows
from usageledger.streaming.ingest import (
    _version_before,
    _version_offset,
    _write_version,
    keep_rejects,
    start,
)


def enrich(
    pods: DataFrame,
    samples_now: Callable[[], DataFrame],
    store: RecordStore,
    queue_path: str,
    checkpoint: str,
    clock: Callable[[int], int],
    max_retries: int,
    interval_seconds: int,
    trigger: str | None = None,
    reachable: Callable[[], bool] = lambda: True,
) -> StreamingQuery:
    """Each batch: queue the new records, try all due entries once, deliver what
    is complete or given up, keep the rest.

    The queue is a small table with one version per batch, made from the version
    before, so a batch that runs again arrives at the same state.  ``clock``
    gives the time of a batch in seconds.  While ``reachable`` says no, nothing is
    tried and no retry is used up; ``retry`` tries without new records.
    """
    spark = store.spark
    offset = _version_offset(spark, queue_path, checkpoint)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        version = offset + batch_id
        before = _version_before(spark, queue_path, version)
        queue = enrichment.enqueue(batch)
        if before is not None:
            waiting = spark.read.schema(enrichment.QUEUE).parquet(before)
            # What waits may be all records so far: never broadcast.
            fresh = queue.join(waiting.select("rid").hint("merge"), "rid", "left_anti")
            queue = waiting.unionByName(fresh.select(*waiting.columns))
        tried = _tried(queue, samples_now, clock(batch_id), max_retries, interval_seconds, reachable())
        rejects = _settle(tried, store, queue_path, version, max_retries)
        keep_rejects(rejects, checkpoint, batch_id)

    return start(pods, each_batch, checkpoint, trigger)


def retry(
    samples_now: Callable[[], DataFrame],
    store: RecordStore,
    queue_path: str,
    now: int,
    max_retries: int,
    interval_seconds: int,
    reachable: bool = True,
) -> DataFrame:
    """Try the due entries of the queue without new records, for a timer between two
    runs of the stream.  Returns the rejected records."""
    newest = _version_before(store.spark, queue_path, 2**62)
    if newest is None or not reachable:
        return no_rows(store.spark, enrichment.RECORD_ADD)
    queue = store.spark.read.schema(enrichment.QUEUE).parquet(newest)
    tried = _tried(queue, samples_now, now, max_retries, interval_seconds, True)
    return _settle(tried, store, queue_path, int(newest.rsplit("=", 1)[1]), max_retries)


def _tried(
    queue: DataFrame,
    samples_now: Callable[[], DataFrame],
    now: int,
    max_retries: int,
    interval_seconds: int,
    reachable: bool,
) -> DataFrame:
    samples = samples_now() if reachable else no_rows(queue.sparkSession, enrichment.SAMPLES)
    return enrichment.merge_step(queue, samples, now, max_retries, interval_seconds, reachable)


def _settle(
    tried: DataFrame, store: RecordStore, queue_path: str, version: int, max_retries: int
) -> DataFrame:
    """Deliver what is done and keep the rest as a version of the queue."""
    attempt = f"{queue_path}-tried/batch={version}"
    # Written once, read twice: what to deliver and what stays.
    tried.write.mode("overwrite").parquet(attempt)
    state = store.spark.read.schema(enrichment.QUEUE).parquet(attempt)
    done = enrichment.emitted(state, max_retries)
    rejects = store.add(done, on_duplicate="skip", on_invalid="skip")
    _write_version(enrichment.remaining(state, max_retries), queue_path, version)
    return rejects


def waiting(store: RecordStore, queue_path: str) -> DataFrame:
    """The newest state of the queue."""
    newest = _version_before(store.spark, queue_path, 2**62)
    if newest is None:
        return no_rows(store.spark, enrichment.QUEUE)
    return store.spark.read.schema(enrichment.QUEUE).parquet(newest).select(
        *[F.col(name) for name in enrichment.QUEUE.fieldNames()]
    )
