"""The record and its variants as Spark types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())]
)
COMPONENT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("amount", T.LongType()),
        T.StructField("scores", T.ArrayType(SCORE)),
    ]
)
META = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
COMPONENTS = T.ArrayType(COMPONENT)

# A record as it is handed in: no runtime, stop_time optional.
RECORD_ADD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("meta", META),
        T.StructField("components", COMPONENTS),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("stop_time", T.TimestampType()),
    ]
)
# A correction: only stop_time takes effect.
RECORD_UPDATE = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("stop_time", T.TimestampType()),
    ]
)
# A record as queries return it.
RECORD = T.StructType(RECORD_ADD.fields + [T.StructField("runtime", T.LongType())])
RECORD_COLUMNS = RECORD.fieldNames()

# A record as the store keeps it.
STORED = T.StructType(
    RECORD.fields
    + [
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("start_month", T.StringType()),
    ]
)

# What the store keeps of its records, corrections, deletions and ids.  The last columns
# are partitions; a segment is numbered by the version that it came with.
STORED_SEGMENT = T.StructType(
    [field for field in STORED if field.name != "start_month"]
    + [T.StructField("segment", T.LongType()), T.StructField("start_month", T.StringType())]
)
CORRECTED = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("stop_time", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("segment", T.LongType()),
        T.StructField("start_month", T.StringType()),
    ]
)
DELETED = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("segment", T.LongType()),
        T.StructField("start_month", T.StringType()),
    ]
)
INDEXED = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("start_month", T.StringType()),
        T.StructField("live", T.BooleanType()),
        T.StructField("since", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)

# A record in a monthly archive: nested parts as JSON text.
ARCHIVED = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("meta", T.StringType()),
        T.StructField("components", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("stop_time", T.TimestampType()),
        T.StructField("runtime", T.LongType()),
    ]
)

META_DDL = META.simpleString()
COMPONENTS_DDL = COMPONENTS.simpleString()
SCORES_DDL = T.ArrayType(SCORE).simpleString()
COMPONENT_DDL = COMPONENT.simpleString()


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table of that schema without rows."""
    nothing = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema]
    return spark.range(0).select(*nothing)
