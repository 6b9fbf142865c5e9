"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def labelled_sample(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """Up to ``bound`` ids with their label, by the order of a hash of the id.

    Ids that are null, have no label, or have several different labels are left
    out.  The result has at most ``bound`` rows, so it may be broadcast.
    """
    one = (
        labels.select("doc_id", F.col(label).alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .drop("other")
    )
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
