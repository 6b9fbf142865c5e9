"""Compare two record sets by id, with tolerance for times and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relative score tolerance (square root of the double epsilon)
# and time tolerance in milliseconds.
SCORE_TOLERANCE = 2.0**-26
TIME_TOLERANCE_MS = 1


def same_score(left: Column, right: Column) -> Column:
    size = F.greatest(F.abs(left), F.abs(right))
    return left.eqNullSafe(right) | (F.abs(left - right) <= SCORE_TOLERANCE * size)


def same_time(left: Column, right: Column) -> Column:
    gap = F.abs(F.unix_micros(left.cast("timestamp")) - F.unix_micros(right.cast("timestamp")))
    return left.eqNullSafe(right) | (gap <= TIME_TOLERANCE_MS * 1000)


def _same_scores(left: Column, right: Column) -> Column:
    pairs = F.arrays_zip(left.alias("a"), right.alias("b"))
    return (F.size(left) == F.size(right)) & F.forall(
        pairs,
        lambda p: p["a"]["name"].eqNullSafe(p["b"]["name"])
        & F.coalesce(same_score(p["a"]["value"], p["b"]["value"]), F.lit(False)),
    )


def same_components(left: Column, right: Column) -> Column:
    pairs = F.arrays_zip(left.alias("a"), right.alias("b"))
    equal = (F.size(left) == F.size(right)) & F.forall(
        pairs,
        lambda p: p["a"]["name"].eqNullSafe(p["b"]["name"])
        & p["a"]["amount"].eqNullSafe(p["b"]["amount"])
        & _same_scores(p["a"]["scores"], p["b"]["scores"]),
    )
    return (left.isNull() & right.isNull()) | F.coalesce(equal, F.lit(False))


def _sorted_entries(meta: Column) -> Column:
    return F.array_sort(F.map_entries(meta))


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per record id: ``status`` is equal, differs, left_only or
    right_only; ``fields`` names what differs."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, F.col("a.record_id") == F.col("b.record_id"), "full")
    checks = {
        "meta": _sorted_entries(F.col("a.meta")).eqNullSafe(_sorted_entries(F.col("b.meta"))),
        "components": same_components(F.col("a.components"), F.col("b.components")),
        "start_time": same_time(F.col("a.start_time"), F.col("b.start_time")),
        "stop_time": same_time(F.col("a.stop_time"), F.col("b.stop_time")),
        "runtime": F.col("a.runtime").eqNullSafe(F.col("b.runtime")),
    }
    differing = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    )
    return joined.select(
        F.coalesce("a.record_id", "b.record_id").alias("record_id"),
        F.when(F.col("b.record_id").isNull(), "left_only")
        .when(F.col("a.record_id").isNull(), "right_only")
        .when(F.size(differing) == 0, "equal")
        .otherwise("differs")
        .alias("status"),
        F.when(
            F.col("a.record_id").isNotNull() & F.col("b.record_id").isNotNull(), differing
        ).alias("fields"),
    )
