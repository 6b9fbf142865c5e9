"""Pod lists of a Kubernetes cluster."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageledger.functions.parsing import quantity_milli
from usageledger.functions.records import make_component, once, record_key, runtime_seconds
from usageledger.operators.query import time_literal
from usageledger.schema import COMPONENT_DDL



def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _TIME = T.StringType(), T.TimestampType()
_RESOURCES = _struct(limits=T.MapType(_TEXT, _TEXT))
_STATE = _struct(terminated=_struct(startedAt=_TIME, finishedAt=_TIME))
POD = _struct(
    metadata=_struct(name=_TEXT, namespace=_TEXT, uid=_TEXT, labels=T.MapType(_TEXT, _TEXT)),
    spec=_struct(containers=T.ArrayType(_struct(name=_TEXT, resources=_RESOURCES))),
    status=_struct(
        phase=_TEXT,
        startTime=_TIME,
        containerStatuses=T.ArrayType(
            _struct(name=_TEXT, resources=_RESOURCES, state=_STATE)
        ),
    ),
)
# Metadata keys and phases.
KEY_PODNAME = "podname"
KEY_NAMESPACE = "namespace"
KEY_STATUS = "status"
UNFINISHED = ("pending", "running", "unknown")


def read_pods(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Pod objects, one JSON object per line; several paths (namespaces) add up."""
    return spark.read.schema(POD).json(paths if isinstance(paths, str) else list(paths))


def parse_pods(text: DataFrame, column: str = "value") -> DataFrame:
    """Pod objects in a text column; each text is read once, whatever is asked
    of the pod later."""
    return text.select(F.inline(F.array(F.from_json(column, POD))))


def filter_pods(
    pods: DataFrame, labels: Mapping[str, str] | None = None, namespaces: Sequence[str] = ()
) -> DataFrame:
    for label, value in (labels or {}).items():
        pods = pods.where(F.try_element_at("metadata.labels", F.lit(label)) == value)
    if namespaces:
        pods = pods.where(F.col("metadata.namespace").isin(*namespaces))
    return pods


def stop_time() -> Column:
    """Latest end of a container, if every container has ended."""
    finished = F.transform("status.containerStatuses", lambda c: c["state"]["terminated"]["finishedAt"])
    return F.when(F.forall(finished, lambda at: at.isNotNull()), F.array_max(finished))


def limits() -> Column:
    """Per container: seconds, and the limits from the status or else the spec.

    The spec must list the container in any case.
    """

    def given(container: Column) -> Column:
        listed = F.filter("spec.containers", lambda c: c["name"] == container["name"])
        resources = once(
            F.try_element_at(listed, F.lit(1)),
            lambda spec: F.when(
                spec.isNotNull(), F.coalesce(container["resources"], spec["resources"])
            ),
        )
        ended = container["state"]["terminated"]
        return F.struct(
            runtime_seconds(ended["startedAt"], ended["finishedAt"]).alias("seconds"),
            resources["limits"].alias("limits"),
        )

    def parsed(container: Column) -> Column:
        def limit(name: str) -> Column:
            return quantity_milli(F.try_element_at(container["limits"], F.lit(name)))

        return F.struct(
            container["seconds"].alias("seconds"),
            limit("cpu").alias("cpu"),
            limit("memory").alias("memory"),
        )

    return F.transform(F.transform("status.containerStatuses", given), parsed)


def pod_components() -> Column:
    """CPU time and memory limits added up; no components if a piece is missing."""
    zero, kind = F.lit(0).cast("bigint"), f"array<{COMPONENT_DDL}>"

    def add(total: Column, container: Column) -> Column:
        spent = F.try_multiply(container["seconds"], container["cpu"])
        return F.struct(
            F.try_add(total["cpu"], spent).alias("cpu"),
            F.try_add(total["memory"], container["memory"]).alias("memory"),
        )

    def components(total: Column) -> Column:
        valid = F.coalesce((total["cpu"] > -1000) & (total["memory"] >= 0), F.lit(False))
        both = F.array(
            make_component("naive_cpu_time", _whole(total["cpu"])),
            make_component("memory_limit", _whole(total["memory"])),
        )
        return F.when(valid, both.cast(kind)).otherwise(F.array().cast(kind))

    nothing = F.struct(zero.alias("cpu"), zero.alias("memory"))
    added = F.aggregate(limits(), nothing, add, components)
    return F.coalesce(added, F.array().cast(kind))


def _whole(milli: Column) -> Column:
    """Integer division that cuts toward zero."""
    return F.call_function("div", milli, F.lit(1000).cast("bigint"))


def to_records(
    pods: DataFrame, record_prefix: str = "kubernetes", last_check: datetime | None = None
) -> DataFrame:
    """Finished pods that ended (after ``last_check``) -> records to add; pods
    without a stop time are left out."""
    name, namespace = F.col("metadata.name"), F.col("metadata.namespace")
    uid, phase = F.col("metadata.uid"), F.col("status.phase")
    finished = pods.where(
        ~F.lower(phase).isin(*UNFINISHED)
        & name.isNotNull() & namespace.isNotNull() & uid.isNotNull()
        & F.col("status.startTime").isNotNull()
    )
    records = finished.select(
        record_key(record_prefix, namespace, name, uid).alias("record_id"),
        F.create_map(
            F.lit(KEY_PODNAME), F.array(name),
            F.lit(KEY_NAMESPACE), F.array(namespace),
            F.lit(KEY_STATUS), F.array(phase),
        ).alias("meta"),
        pod_components().alias("components"),
        F.date_trunc("millisecond", "status.startTime").alias("start_time"),
        F.date_trunc("millisecond", stop_time()).alias("stop_time"),
    )
    if last_check is None:
        return records.where(F.col("stop_time").isNotNull())
    return records.where(F.col("stop_time") > time_literal(last_check, T.TimestampType()))
