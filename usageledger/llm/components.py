"""Connected components of a link table, as Spark jobs.

Large-star and small-star steps: each node points to the smallest node among its
neighbours, until nothing changes.  Every step is written to the shared scratch
folder, so that a lost executor costs no recomputation of earlier steps.

The neighbours of a node meet its smallest one under the node's id.  A node with more
than one part in ``HUBS`` of all links is a hub; there are at most ``HUBS`` of them at any
size, so their smallest neighbours are broadcast and their links stay spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageledger.session import materialize

HUBS = 1024


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))


def _meet(pairs: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """u, v and m, the smallest neighbour of u.  The degrees of ``least`` add up to
    ``rows`` at most, so that no more than ``HUBS`` nodes are above their share."""
    hubs = least.where(F.col("degree") > rows / HUBS).select("u", F.col("m").alias("hub_m"))
    salt = F.when(F.col("hub_m").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("v"), F.lit(HUBS)))
    dealt = pairs.join(F.broadcast(hubs), "u", "left").withColumn("salt", salt.cast("int"))
    # Always 0, but not as a literal: that would be taken out of the key.
    unsalted = (F.col("degree") < 0).cast("int").alias("salt")
    return dealt.join(least.select("u", unsalted, "m"), ["u", "salt"], "left").select(
        "u", "v", F.coalesce("hub_m", "m").alias("m")
    )


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Join every larger neighbour of a node to the smallest of the neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = _least(both).withColumn("m", F.least("m", "u"))
    return _meet(both.where("v > u"), least, 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Join the smaller neighbours of a node, and the node, to the smallest of them."""
    least = _least(edges)
    return (
        _meet(edges, least, rows)
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """node, component_id (the smallest node reachable) for every node that has a
    link to another one.  Nulls and loops link nothing; repeated links count once."""
    edges = links.select(
        F.greatest(first, second).alias("u"), F.least(first, second).alias("v")
    ).where(F.col(first).isNotNull() & F.col(second).isNotNull() & (F.col(first) != F.col(second)))
    edges = materialize(edges.distinct(), "links")
    rows, sign = edges.count(), None
    while True:
        edges = materialize(_small_star(_large_star(edges, rows), rows), "links")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("v")
        ).first()
        if now == sign:
            break
        rows, sign = now[0], now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    )
