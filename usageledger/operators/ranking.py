"""The place of every row in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.session import materialize

#: ``monotonically_increasing_id`` has the task above these bits and the row below them.
_ROW_BITS = 33


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with a column that counts its rows in an order, from 1.

    Rows are dealt out by ranges of the order and sorted in each range, so no task has
    more than its range; a row's place is its place in the range plus the rows of the
    ranges before.  The sorted table is written once.  Only the sizes of the ranges, one
    number for each task, come to the driver.  Rows that are equal in the order get
    different places.  Nulls stand where the order puts them.
    """
    ordered = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", _ROW_BITS)
    sizes = ordered.groupBy(part.alias("part")).count().collect()
    before, offsets = 0, []
    for row in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((row["part"], before))
        before += row["count"]
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long"))
    table = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    inner = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .select(*df.columns, (F.col("_before") + inner).alias(name))
    )
