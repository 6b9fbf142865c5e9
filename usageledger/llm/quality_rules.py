"""Quality rules: log-likelihood ratio of hashed n-grams.

Two multinomials over hashed byte 4-grams are counted: one over all texts (the
raw corpus), one over a trusted target.  A text's score is the mean over its
4-grams of log p(target) - log p(raw); it is kept if the score reaches a fixed
threshold.  Nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageledger.llm import textops
from usageledger.llm.docstats import Stats
from usageledger.llm.shipping import map_arrow

BUCKETS = 1 << 15
THRESHOLD = -0.35
SMOOTHING = 0.5
#: Bits of the filter of good ids, 4 MiB: about 3 of 100 other texts pass it with a million
#: good ids, and all with some 100 million; they then cost a shuffle and nothing else.
FILTER_BITS = 1 << 25

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, score double, kept boolean"
)


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each 4-gram inside a row, and how many each row has."""
    count = np.maximum(np.diff(off) - 3, 0)
    if not count.sum():
        return np.empty(0, np.int64), count
    wide = buf.astype(np.uint32)
    value = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    inside = np.ones(len(value), bool)
    for k in range(1, 4):
        crossing = off[1:-1] - k
        inside[crossing[(crossing >= 0) & (crossing < len(value))]] = False
    value = value[inside] * np.uint32(0x9E3779B1)
    return (value >> np.uint32(17)).astype(np.int64), count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, buf, off in textops.pieces(batch.column("text")):
            total += np.bincount(_grams(buf, off)[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def _counts(texts: DataFrame) -> np.ndarray:
    """4-grams of each bucket over all texts; one row per bucket reaches the driver."""
    rows = texts.select("text").transform(map_arrow, _count, "bucket int, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS)
    total[found["bucket"]] = found["n"]
    return total


def _marked(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of every id: ``FILTER_BITS`` bits however many ids there are."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(h).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows.collect():
        bits = np.frombuffer(row["bits"], np.uint8)
        at = (row["part"] - 1) * len(bits)
        out[at : at + len(bits)] = bits
    return out


def _of_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``documents`` that have one of the ids.

    Texts whose id is marked in a filter of fixed size are dealt out by their id and
    joined; the others, but for a few whose mark is another's, stay where they are.
    """
    shared = documents.sparkSession.sparkContext.broadcast(_marked(ids))
    rows = documents.select(F.col("doc_id").cast("long"), "text").withColumn(
        "mark", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            at = np.asarray(batch.column("mark"))
            there = marks[at >> 3] >> (at & 7).astype(np.uint8) & 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(there.astype(bool)))

    marked = rows.where("doc_id IS NOT NULL").transform(map_arrow, run, "doc_id long, text string")
    return marked.join(ids.hint("merge"), "doc_id", "left_semi")


def fit(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of each bucket.  Raw counts cover all texts, the target all documents
    labelled good; without a target every ratio is 0."""
    trusted = (
        labels.where("quality = 1 AND doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"))
        .distinct()
    )
    raw, target = _counts(documents), _counts(_of_ids(documents, trusted))
    if not target.sum():
        return np.zeros(BUCKETS)
    share = [(c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS) for c in (target, raw)]
    return np.log(share[0]) - np.log(share[1])


def score(documents: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The base rules, the score and the verdict for every row of ``documents``.

    A null text counts as no words.  A text of under four bytes scores 0; rows
    with under 50 words or with more than half of the words in repeated 3-word
    windows fail the base rules and are not kept, whatever the score.  Repeated
    rows are judged one by one; columns besides doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, off in textops.pieces(batch.column("text")):
                stats = Stats(buf, off)
                grams, count = _grams(buf, off)
                ends = np.cumsum(count)
                total = np.r_[0.0, np.cumsum(ratio[grams])]
                mean = (total[ends] - total[ends - count]) / np.maximum(count, 1)
                mean = np.round(mean, 9)
                failed = (stats.n_words < 50) | (100 * stats.n_repeat_words > 50 * stats.n_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first),
                        *(
                            pa.array(x.astype(np.int64))
                            for x in (
                                stats.n_words,
                                stats.word_chars,
                                stats.n_symbols,
                                stats.n_dup_lines,
                                stats.n_repeat_words,
                            )
                        ),
                        pa.array(failed),
                        pa.array(mean),
                        pa.array(~failed & (mean >= threshold)),
                    ],
                    names=[part.split()[0] for part in SCHEMA.split(", ")],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, run, SCHEMA)


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on ``documents`` and ``labels`` and judge every row of ``documents``."""
    return score(documents, fit(documents, labels), threshold)
