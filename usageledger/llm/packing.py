"""Packing: optimal length buckets and token-budget batches.

Texts are cut to pieces of at most ``max_len`` tokens.  Dynamic programming over
the global histogram of piece lengths picks the bucket lengths with the least
padding; inside a bucket, pieces are numbered and cut to batches whose padded size
stays within a token budget.  A token is a word, plus one end mark per text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from usageledger.session import materialize

MAX_LEN = 2048
BUCKETS = 12
BATCH_TOKENS = 65_536
SHARD_ROWS = 8_192
_WORD = r"[^\x20\x09-\x0D]++"


def best_buckets(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Bucket lengths, ascending, that pad the histogram least; each piece goes to
    the shortest bucket that holds it.  Of equally good choices the first is taken."""
    if not lengths:
        return []
    order = np.argsort(lengths)
    size, number = np.array(lengths)[order], np.array(counts, np.float64)[order]
    n = len(size)
    pieces = np.r_[0.0, np.cumsum(number)]
    tokens = np.r_[0.0, np.cumsum(number * size)]
    # waste[i, j]: padding of lengths i..j-1 in a bucket of size[j-1]
    waste = size[None, :] * (pieces[None, 1:] - pieces[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    waste[np.tril_indices(n, -1)] = np.inf
    cost, cuts = waste[0].copy(), []
    for _ in range(1, min(buckets, n)):
        total = np.r_[np.inf, cost[:-1]][:, None] + waste
        start = total.argmin(axis=0)
        better = total[start, np.arange(n)]
        cuts.append(np.where(better < cost, start, 0))
        cost = np.minimum(better, cost)
    out, end = [], n
    for cut in reversed(cuts):
        out.append(int(size[end - 1]))
        end = int(cut[end - 1])
        if end == 0:
            return out[::-1]
    return [int(size[end - 1]), *out[::-1]]


def lengths_of(documents: DataFrame) -> DataFrame:
    """doc_id and the tokens of each text; a null or empty text has the end mark only."""
    words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0))
    return documents.select(F.col("doc_id").cast("long"), (words + 1).cast("long").alias("tokens"))


def pack(
    lengths: DataFrame,
    max_len: int = MAX_LEN,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """One row per piece of each row of ``lengths`` (doc_id, tokens): piece,
    start_token, n_tokens, bucket_len, batch_id (counted inside the bucket), slot
    (place in the batch) and padding.

    No table larger than ``max_len`` rows reaches the driver.  Every batch of a
    bucket is full but the last; a batch holds at least one piece.  Repeated rows
    are packed one by one; a null doc_id is packed like any other.
    """
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / max_len).cast("int") - 1))
    parts = materialize(lengths, "lengths").select("doc_id", "tokens", piece.alias("piece"))
    parts = parts.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * max_len).alias("start_token"),
        F.least(F.col("tokens") - F.col("piece").cast("long") * max_len, F.lit(max_len)).cast("long").alias("n_tokens"),
    )
    histogram = parts.groupBy("n_tokens").count().collect()
    bounds = best_buckets([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], buckets)
    total = sum(r["count"] for r in histogram)
    shards = max(1, -(-total // SHARD_ROWS))
    choices = F.lit(bounds or [0]).cast(T.ArrayType(T.LongType()))
    bucket = F.element_at(F.filter(choices, lambda size: size >= F.col("n_tokens")), 1)
    placed = parts.withColumn("bucket_len", bucket).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))
    )
    before = Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("bucket_len", "shard")
        .agg(F.count("*").alias("here"))
        .select("bucket_len", "shard", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("bucket_len", "shard").orderBy("doc_id", "piece", "n_tokens")
    place = F.col("offset") + F.col("number") - 1
    per_batch = F.greatest(F.expr(f"{batch_tokens}L div bucket_len"), F.lit(1))
    return (
        placed.withColumn("number", F.row_number().over(inside))
        .join(offsets, ["bucket_len", "shard"])
        .select(
            "doc_id",
            "piece",
            "start_token",
            "n_tokens",
            "bucket_len",
            F.floor(place / per_batch).cast("long").alias("batch_id"),
            (place % per_batch).cast("long").alias("slot"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )


def packing(documents: DataFrame, **settings: int) -> DataFrame:
    """Pack every text of ``documents``; columns besides doc_id and text are ignored."""
    return pack(lengths_of(documents), **settings)
