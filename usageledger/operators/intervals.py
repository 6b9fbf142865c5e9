"""Join of intervals with timed samples, and reset-aware counter increase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageledger.operators.lookup import BROADCAST_ROWS

# Length of the pieces a series is cut into, so that a series with very many
# samples is spread over tasks.
PIECE_SECONDS = 3600
# Length of the buckets in which spans and samples meet.
BUCKET_SECONDS = 3600


def samples_within(
    spans: DataFrame, samples: DataFrame, bucket_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """Samples that fall into a span of the same (namespace, pod).

    ``spans``: record_id, namespace, pod, start_time, stop_time.  The window
    reaches back from the stop by the duration plus one second.  Spans are cut to
    buckets of time and a sample lies in one of them, so a hot pod is spread over
    as many keys as it has buckets, and a sample is compared only with spans of its
    bucket.  The first and last moment of all spans, two numbers on the driver, are a
    condition on the samples that reaches their scan.  The number of pieces says
    whether they may be broadcast; their size before they are cut does not.
    """
    seconds = F.timestamp_diff("SECOND", F.col("start_time"), F.col("stop_time")) + 1
    until = F.unix_micros(F.col("stop_time").cast("timestamp"))
    bounded = spans.where(F.col("stop_time").isNotNull()).select(
        "record_id",
        "namespace",
        "pod",
        until.alias("until"),
        (until - seconds * 1_000_000).alias("since"),
    )
    bounded = bounded.where("since <= until")

    def bucket(micros: Column) -> Column:
        return F.floor(micros / (bucket_seconds * 1_000_000))

    ends = bounded.agg(
        F.min("since").alias("since"),
        F.max("until").alias("until"),
        F.sum(bucket(F.col("until")) - bucket(F.col("since")) + 1).alias("pieces"),
    ).first()
    if ends["since"] is None:
        samples = samples.where(F.lit(False))
    else:
        samples = samples.where(_between(samples, "ts", ends["since"], ends["until"]))
    pieces = bounded.withColumn("bucket", F.explode(F.sequence(bucket(F.col("since")), bucket(F.col("until")))))
    pieces = F.broadcast(pieces) if (ends["pieces"] or 0) <= BROADCAST_ROWS else pieces.hint("merge")
    timed = samples.select(
        "namespace",
        "pod",
        "metric",
        "series",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "value",
    ).withColumn("bucket", bucket(F.col("at")))
    return (
        timed.join(pieces, ["namespace", "pod", "bucket"])
        .where(F.col("at").between(F.col("since"), F.col("until")))
        .select("record_id", "metric", "series", "at", "value")
    )


def _between(df: DataFrame, name: str, since: int, until: int) -> Column:
    """A condition on the bare column, so that it reaches the scan.  A time without a zone
    may be read in any zone: the bounds are a day wider for it."""
    plain = isinstance(df.schema[name].dataType, T.TimestampNTZType)
    slack = 86_400_000_000 if plain else 0
    kind = df.schema[name].dataType
    low, high = (F.timestamp_micros(F.lit(m)).cast(kind) for m in (since - slack, until + slack))
    return (F.col(name) >= low) & (F.col(name) <= high)


def counter_increase(points: DataFrame, piece_seconds: int = PIECE_SECONDS) -> DataFrame:
    """(record_id, series, at, value) -> increase per record and series.

    A drop is a counter reset: the value after it counts in full.  A series
    needs two samples.  Each series is cut into pieces of time; the pieces are
    summed on their own and then joined at their edges, so no task sees a whole
    long series.
    """
    keys = ["record_id", "series"]
    pieces = [*keys, "piece"]
    # Copies of a sample collapse before the shuffle.
    samples = (
        points.withColumn("piece", F.floor(F.col("at") / (piece_seconds * 1_000_000)))
        .groupBy(*pieces, "at")
        .agg(F.max("value").alias("value"))
    )

    def step(value, before):
        return F.when(before.isNull(), 0.0).when(value < before, value).otherwise(value - before)

    inside = Window.partitionBy(*pieces).orderBy("at")
    per_piece = (
        samples.withColumn("step", step(F.col("value"), F.lag("value").over(inside)))
        .groupBy(*pieces)
        .agg(
            F.sum("step").alias("inner"),
            F.min_by("value", "at").alias("first"),
            F.max_by("value", "at").alias("last"),
            F.count("*").alias("n"),
        )
    )
    along = Window.partitionBy(*keys).orderBy("piece")
    return (
        per_piece.withColumn("edge", step(F.col("first"), F.lag("last").over(along)))
        .groupBy(*keys)
        .agg(
            F.sum(F.col("inner") + F.col("edge")).alias("increase"),
            F.sum("n").alias("n"),
        )
        .where(F.col("n") >= 2)
        .select(*keys, "increase")
    )


def gauge_maximum(points: DataFrame) -> DataFrame:
    """(record_id, series, value) -> largest value per record and series."""
    return points.groupBy("record_id", "series").agg(F.max("value").alias("maximum"))
