"""Incremental jobs, run over the tables until all input is taken."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from usageledger.catalog.collectors import (
    CONDOR,
    DUMP,
    SLURM_SQL,
    pod_flat,
    slurm_flat,
)
from usageledger.catalog.filters import flat
from usageledger.catalog.registry import query
from usageledger.catalog.reports import KEYS
from usageledger.catalog.sinks import UPDATED_SQL, closing
from usageledger.catalog.tables import (
    condor_lines,
    event_records,
    metric_samples,
    pod_texts,
    slurm_lines,
    table,
    to_event_records,
    zoned,
)
from usageledger.functions.records import component_amount, first_meta
from usageledger.operators.reshape import to_added
from usageledger.plans import enrichment
from usageledger.plans.files import names_in
from usageledger.plans.store import RecordStore
from usageledger.session import scratch_path
from usageledger.sources import htcondor, kubernetes, slurm
from usageledger.streaming import backlog, counts, ingest


# Batches that files come in, and files of each, so that tasks write and read them together.
DROPS, DROP_FILES = 3, 8


def _finish(running) -> None:
    running.awaitTermination()


def _share(spark, folder: str) -> int:
    """Files of a batch where the files of a folder come in ``DROPS`` batches."""
    files = sum(name.startswith("part-") for name in names_in(spark, folder))
    return max(1, -(-files // DROPS))


@query("t1_slurm_ingest", SLURM_SQL)
def slurm_ingest(spark, sf_dir):
    """Several drops, one per batch, with the lines of a job in any of them; what is
    still incomplete at the end is flushed.  Then all of them once more."""
    drops = scratch_path(spark, "drops")
    slurm_lines(spark, sf_dir, pieces=DROPS * DROP_FILES).write.text(drops)
    store = RecordStore(spark, scratch_path(spark, "store"))
    pending = scratch_path(spark, "pending")
    for attempt in ("first", "again"):
        lines = ingest.text_stream(spark, drops, files_per_batch=_share(spark, drops))
        checkpoint = scratch_path(spark, f"checkpoint-{attempt}")
        _finish(ingest.ingest_jobs(lines, DUMP, store, pending, checkpoint))
        ingest.flush_jobs(DUMP, store, pending)
    return slurm_flat(store.records())


@query("s15_incremental_source", "SELECT CAST(event_id AS VARCHAR) AS job, cores FROM ev")
def incremental_source(spark, sf_dir):
    """Only the job lines, parsed as they arrive."""
    drops = scratch_path(spark, "drops")
    slurm_lines(spark, sf_dir, pieces=2).write.text(drops)
    rows = slurm.split_lines(ingest.text_stream(spark, drops), DUMP)
    jobs = rows.where(~F.col("JobID").rlike(slurm.STEP_ID)).select(
        F.col("JobID").alias("job"), slurm.parse_value(F.col("NCPUS"), "Integer").alias("cores")
    )
    target = scratch_path(spark, "jobs")
    _finish(
        jobs.writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start(target)
    )
    return spark.read.parquet(target)


@query(
    "t2_condor_ingest",
    """SELECT 'schedd' || CAST(uid % 3 AS VARCHAR) AS schedd, max(event_id) AS cluster,
              CAST(0 AS BIGINT) AS proc FROM ev GROUP BY 1""",
)
def condor_ingest(spark, sf_dir):
    _, marks = _ingested_condor(spark, sf_dir)
    return marks


@query(
    "t2_condor_records",
    """SELECT 'htcondor-submit#' || event_id || '.0#' || CAST(floor(epoch(start_time)) AS BIGINT) AS record_id,
              user_id, cores, seconds AS cpu, date_trunc('second', start_time) AS start_time
       FROM ev WHERE k <> 0""",
)
def condor_ingested_records(spark, sf_dir):
    store, _ = _ingested_condor(spark, sf_dir)
    return store.records().select(
        "record_id",
        first_meta("user").alias("user_id"),
        component_amount("Cores").alias("cores"),
        component_amount("UserCPU").alias("cpu"),
        "start_time",
    )


def _ingested_condor(spark, sf_dir):
    """The store and the marks after the history was taken, and taken again."""
    drops, checkpoint = scratch_path(spark, "drops"), scratch_path(spark, "checkpoint")
    store = RecordStore(spark, scratch_path(spark, "store"))
    marks = scratch_path(spark, "marks")
    for _ in range(2):
        condor_lines(spark, sf_dir).write.mode("append").partitionBy("schedd").text(drops)
        lines = ingest.text_stream(spark, drops)
        _finish(ingest.ingest_history(lines, CONDOR, store, marks, checkpoint))
    return store, ingest.marks(spark, marks)


@query(
    "t3_pod_ingest",
    """SELECT 'kubernetes-' || site || '-pod-' || event_id || '-uid-' || event_id AS record_id,
              'pod-' || event_id AS podname, site AS namespace, 'Succeeded' AS status,
              (seconds * cores * 500 + seconds * 1000) // 1000 AS cpu_time, 2684354560 AS memory,
              date_trunc('milliseconds', start_time) AS start_time,
              date_trunc('milliseconds', ended) AS stop_time
       FROM ev WHERE group_id <> 'error' AND k >= 10
         AND date_trunc('milliseconds', ended) > TIMESTAMP '2024-01-08'""",
)
def pod_ingest(spark, sf_dir):
    drops = scratch_path(spark, "drops")
    pod_texts(spark, sf_dir).write.text(drops)
    mark = ingest.not_before(
        datetime(2024, 1, 2, tzinfo=timezone.utc), datetime(2024, 1, 8, tzinfo=timezone.utc)
    )
    store = RecordStore(spark, scratch_path(spark, "store"))
    pods = ingest.pod_stream(spark, drops)
    _finish(
        ingest.ingest(
            pods, kubernetes.to_records, store, scratch_path(spark, "checkpoint"), earliest=mark
        )
    )
    return pod_flat(store.records())


@query(
    "t4_enrichment_backlog",
    """WITH spans AS (SELECT 'kubernetes-' || site || '-' || user_id || '-' || event_id AS record_id, site, user_id,
                             start_time, stop_time FROM ev WHERE group_id = 'signup'),
       points AS (SELECT p.record_id, s.k % 2 AS series, s.start_time AS ts, max(s.k) AS counter,
                         max(s.seconds * 1024) AS gauge
                  FROM spans p JOIN ev s ON p.site = s.site AND p.user_id = s.user_id
                  WHERE s.start_time >= p.start_time - INTERVAL 1 SECOND
                    AND s.start_time <= p.start_time + INTERVAL 12 HOUR GROUP BY 1, 2, 3),
       steps AS (SELECT *, counter - lag(counter) OVER (PARTITION BY record_id, series ORDER BY ts) AS delta
                 FROM points),
       per_series AS (SELECT record_id, series, count(*) AS n, max(gauge) AS gauge,
                             sum(CASE WHEN delta < 0 THEN counter ELSE coalesce(delta, 0) END) AS increase
                      FROM steps GROUP BY 1, 2),
       measured AS (SELECT record_id, CAST(sum(CASE WHEN n >= 2 THEN increase END) AS BIGINT) AS cpu,
                           CAST(sum(gauge) AS BIGINT) AS memory FROM per_series GROUP BY 1)
       SELECT record_id, cpu, CASE WHEN cpu IS NOT NULL THEN memory END AS memory
       FROM spans LEFT JOIN measured USING (record_id)""",
)
def enrichment_backlog(spark, sf_dir):
    """Pods arrive in three batches, then the queue is tried on a timer; one retry,
    then they are given up."""
    pods = _signup_pods(spark, sf_dir)
    drops = scratch_path(spark, "drops")
    pods.repartition(3, "record_id").write.parquet(drops)
    stream = ingest.parquet_stream(spark, drops, pods.schema, files_per_batch=1)
    store = RecordStore(spark, scratch_path(spark, "store"))
    queue = scratch_path(spark, "queue")
    _finish(
        backlog.enrich(
            stream,
            lambda: metric_samples(spark, sf_dir),
            store,
            queue,
            scratch_path(spark, "checkpoint"),
            clock=lambda batch: 1000 * (batch + 1),
            max_retries=1,
            interval_seconds=100,
        )
    )
    for now in (10_000, 20_000, 30_000):
        backlog.retry(lambda: metric_samples(spark, sf_dir), store, queue, now, 1, 100)
    return store.records().select(
        "record_id", component_amount("cpu").alias("cpu"), component_amount("memory").alias("memory")
    )


@query(
    "t5_rejected_records",
    "SELECT record_id FROM ev WHERE uid % 5 = 0",
)
def rejected_records(spark, sf_dir):
    """Every fifth user has a blank value, which the store does not take."""
    added = to_added(zoned(event_records(spark, sf_dir)))
    bad = F.substring(first_meta("user_id"), 2, 10).cast("bigint") % 5 == 0
    blank = F.create_map(F.lit("note"), F.array(F.lit(" ")))
    meta = F.when(bad, F.map_concat("meta", blank)).otherwise(F.col("meta"))
    messages = added.withColumn("meta", meta).select(F.lit(ingest.INSERT).alias("kind"), *added.columns)
    drops, checkpoint = scratch_path(spark, "drops"), scratch_path(spark, "checkpoint")
    messages.write.parquet(drops)
    stream = ingest.parquet_stream(spark, drops, ingest.MESSAGE)
    store = RecordStore(spark, scratch_path(spark, "store"))
    _finish(ingest.deliver(stream, store, scratch_path(spark, "pending"), checkpoint))
    return ingest.rejected(spark, checkpoint).select("record_id")


def _signup_pods(spark, sf_dir):
    """Records of pods that live for twelve hours after a signup."""
    records = event_records(spark, sf_dir).where(first_meta("group_id") == "signup")
    return records.select(
        F.concat(
            F.lit("kubernetes-"), first_meta("site"), F.lit("-"), first_meta("user_id"), F.lit("-"),
            F.substring_index("record_id", "-", -1),
        ).alias("record_id"),
        F.create_map(
            F.lit(kubernetes.KEY_NAMESPACE), F.array(first_meta("site")),
            F.lit(kubernetes.KEY_PODNAME), F.array(first_meta("user_id")),
        ).alias("meta"),
        F.array().cast(enrichment.RECORD_ADD["components"].dataType).alias("components"),
        F.col("start_time").cast("timestamp").alias("start_time"),
        (F.col("start_time") + F.expr("INTERVAL 12 HOURS")).cast("timestamp").alias("stop_time"),
    )


@query("t5_store_and_forward", UPDATED_SQL)
def store_and_forward(spark, sf_dir):
    """Updates come before their inserts, and everything is delivered twice."""
    added = to_added(zoned(event_records(spark, sf_dir)))
    inserts = added.select(F.lit(ingest.INSERT).alias("kind"), *added.columns)
    updates = closing(added, 90)
    early = ingest.MESSAGE
    update_messages = updates.select(
        F.lit(ingest.UPDATE).alias("kind"),
        "record_id",
        F.lit(None).cast(early["meta"].dataType).alias("meta"),
        F.lit(None).cast(early["components"].dataType).alias("components"),
        F.lit(None).cast("timestamp").alias("start_time"),
        "stop_time",
    )
    first, second = scratch_path(spark, "messages"), scratch_path(spark, "messages")
    store = RecordStore(spark, scratch_path(spark, "store"))
    pending, checkpoint = scratch_path(spark, "pending"), scratch_path(spark, "checkpoint")
    for messages in (update_messages, inserts):
        messages.write.mode("append").parquet(first)
        _finish(ingest.deliver(ingest.parquet_stream(spark, first, ingest.MESSAGE), store, pending, checkpoint))
    inserts.unionByName(update_messages).write.parquet(second)
    stream = ingest.parquet_stream(spark, second, ingest.MESSAGE, files_per_batch=_share(spark, second))
    _finish(
        ingest.deliver(
            stream, store, scratch_path(spark, "pending"), scratch_path(spark, "checkpoint")
        )
    )
    return flat(store.records())


def _event_stream(spark, sf_dir):
    """The events table as a stream, whether it is a file or a folder."""
    schema = table(spark, sf_dir, "events").schema
    return ingest.parquet_stream(spark, f"{sf_dir}/events.parque[t]", schema)


@query(
    "t8_continuous_counts",
    """SELECT 'site' AS label, site AS label_value, count(*) AS num FROM ev GROUP BY site
       UNION ALL SELECT 'group_id' AS label, group_id AS label_value, count(*) AS num FROM ev GROUP BY group_id
       UNION ALL SELECT 'user_id' AS label, user_id AS label_value, count(*) AS num FROM ev GROUP BY user_id""",
)
def continuous_counts(spark, sf_dir):
    target = scratch_path(spark, "counts")
    records = to_event_records(_event_stream(spark, sf_dir))
    _finish(counts.count_metrics(records, KEYS, target, scratch_path(spark, "checkpoint")))
    return spark.read.parquet(target)


DAYS_SQL = """SELECT CAST(stop_time AS DATE) AS day, count(*) AS num, CAST(sum(runtime) AS BIGINT) AS runtime
  FROM ev WHERE stop_time IS NOT NULL GROUP BY 1"""


@query("t9_daily_slices", DAYS_SQL)
def daily_slices(spark, sf_dir):
    return counts.daily_counts(event_records(spark, sf_dir))


@query("t9_daily_slices_stream", DAYS_SQL)
def daily_slices_stream(spark, sf_dir):
    target = scratch_path(spark, "days")
    records = to_event_records(_event_stream(spark, sf_dir))
    _finish(
        counts.keep_table(counts.daily_counts(records), target, scratch_path(spark, "checkpoint"))
    )
    return spark.read.parquet(target)

