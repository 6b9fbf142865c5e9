"""Complete pod records with measured CPU time and memory.

Records wait in a queue table until the samples are there, or until they were
tried too often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageledger.functions.numbers import half_away
from usageledger.functions.records import make_component
from usageledger.operators.intervals import counter_increase, gauge_maximum, samples_within
from usageledger.schema import COMPONENTS_DDL, RECORD_ADD
from usageledger.sources.kubernetes import KEY_NAMESPACE, KEY_PODNAME

QUEUE = T.StructType(
    [
        T.StructField("rid", T.StringType()),
        T.StructField("record", RECORD_ADD),
        T.StructField("retry", T.IntegerType()),
        T.StructField("updated", T.LongType()),
        T.StructField("complete", T.BooleanType()),
    ]
)
SAMPLES = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("pod", T.StringType()),
        T.StructField("series", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)
# Metric names and the components they become.
CPU_METRIC = "pod_cpu_usage_seconds_total"
MEMORY_METRIC = "pod_memory_working_set_bytes"
CPU = "cpu"
MEMORY = "memory"


def enqueue(records: DataFrame) -> DataFrame:
    """New queue entries: never tried, due at once."""
    return records.select(
        F.col("record_id").alias("rid"),
        F.struct(*RECORD_ADD.fieldNames()).alias("record"),
        F.lit(0).alias("retry"),
        F.lit(0).cast("bigint").alias("updated"),
        F.lit(False).alias("complete"),
    )


def due(now: int, max_retries: int, interval: int) -> Column:
    return (
        (F.col("retry") <= max_retries)
        & (F.col("updated") <= now - interval)
        & ~F.col("complete")
    )


def given_up(max_retries: int) -> Column:
    return (F.col("retry") > max_retries) & ~F.col("complete")


def _single(key: str) -> Column:
    values = F.try_element_at("record.meta", F.lit(key))
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def well_formed() -> Column:
    """Has a stop time, one namespace and one pod name."""
    return (
        F.col("record.stop_time").isNotNull()
        & _single(KEY_NAMESPACE).isNotNull()
        & _single(KEY_PODNAME).isNotNull()
    )


def _has(name: str) -> Column:
    return F.coalesce(F.exists("record.components", lambda c: c["name"] == name), F.lit(False))


def spans(queue: DataFrame) -> DataFrame:
    return queue.where(well_formed()).select(
        F.col("rid").alias("record_id"),
        _single(KEY_NAMESPACE).alias("namespace"),
        _single(KEY_PODNAME).alias("pod"),
        "record.start_time",
        "record.stop_time",
    )


def measured(pods: DataFrame, samples: DataFrame) -> DataFrame:
    """(record_id, cpu, memory): counter increase and gauge maximum over the
    pod's time, added up over its series; null without samples.

    The increase is the sum of the observed steps; it is not extrapolated to
    the edges of the window.
    """
    wanted = samples.where(F.col("metric").isin(CPU_METRIC, MEMORY_METRIC))
    points = samples_within(pods, wanted)
    cpu = counter_increase(points.where(F.col("metric") == CPU_METRIC)).select(
        "record_id", F.col("increase").alias("cpu"), F.lit(None).cast("double").alias("memory")
    )
    memory = gauge_maximum(points.where(F.col("metric") == MEMORY_METRIC)).select(
        "record_id", F.lit(None).cast("double").alias("cpu"), F.col("maximum").alias("memory")
    )
    return (
        cpu.unionByName(memory)
        .groupBy("record_id")
        .agg(half_away(F.sum("cpu")).alias("cpu"), half_away(F.sum("memory")).alias("memory"))
    )


def fill(queue: DataFrame, samples: DataFrame, now: int) -> DataFrame:
    """Queue entries after one attempt.

    CPU comes first: without it the memory is not added either.  A complete
    record keeps its retry count, an incomplete one is tried once more later.
    """
    found = measured(spans(queue), samples).withColumnRenamed("record_id", "rid")
    # As many rows as the queue has entries, which may be all records: never broadcast.
    joined = queue.join(found.hint("merge"), "rid", "left")
    none = F.array().cast(COMPONENTS_DDL)
    cpu_added = ~_has(CPU) & F.col("cpu").isNotNull()
    cpu_there = _has(CPU) | F.col("cpu").isNotNull()
    memory_added = cpu_there & ~_has(MEMORY) & F.col("memory").isNotNull()
    complete = cpu_there & (_has(MEMORY) | F.col("memory").isNotNull())
    components = F.concat(
        F.coalesce("record.components", none),
        F.when(cpu_added, F.array(make_component(CPU, F.col("cpu")))).otherwise(none),
        F.when(memory_added, F.array(make_component(MEMORY, F.col("memory")))).otherwise(none),
    )
    return joined.select(
        "rid",
        F.col("record").withField("components", components).alias("record"),
        F.when(complete, F.col("retry")).otherwise(F.col("retry") + 1).cast("int").alias("retry"),
        F.lit(now).cast("bigint").alias("updated"),
        complete.alias("complete"),
    )


def merge_step(
    queue: DataFrame,
    samples: DataFrame,
    now: int,
    max_retries: int,
    interval: int,
    reachable: bool = True,
) -> DataFrame:
    """The queue after all due entries were tried once.

    If the samples cannot be reached nothing changes, so it costs no retry.  An
    entry that is malformed stays as it is.
    """
    if not reachable:
        return queue
    trying = due(now, max_retries, interval) & well_formed()
    tried = fill(queue.where(trying), samples, now)
    return queue.where(~trying).unionByName(tried)


def emitted(queue: DataFrame, max_retries: int) -> DataFrame:
    """Records to deliver: the complete ones and the ones given up."""
    return queue.where(F.col("complete") | given_up(max_retries)).select("record.*")


def remaining(queue: DataFrame, max_retries: int) -> DataFrame:
    return queue.where(~(F.col("complete") | given_up(max_retries)))
