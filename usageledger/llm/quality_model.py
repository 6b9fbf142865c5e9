"""Quality classifier: regularised quadratic discriminant.

Transformed statistics of a text (docstats) are modelled by one normal
distribution per class.  Each covariance is shrunk towards the pooled variances;
its Cholesky factor is computed once, and a score is the logistic of the
difference of the two log densities plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageledger.llm import textops
from usageledger.llm.docstats import Stats
from usageledger.llm.sampling import fold, labelled_sample
from usageledger.llm.shipping import map_arrow

TRAINING_ROWS = 50_000
SHRINKAGE = 0.2
RIDGE = 0.02
CUT = 0.3


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of both classes."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            z = (x - mean) @ factor.T
            logs.append(constant - 0.5 * np.einsum("ij,ij->i", z, z))
        odds = np.clip(logs[1] - logs[0], -500, 500)
        return np.round(1 / (1 + np.exp(-odds)), 9)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: count, sums and products of the features, as (class, place, value)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(int)
        for first, end, buf, off in textops.pieces(batch.column("text")):
            x = Stats(buf, off).features()
            x = np.column_stack([np.ones(len(x)), x])
            for kind in (0, 1):
                own = x[label[first:end] == kind]
                total[kind] = total.get(kind, 0) + own.T @ own
    for kind, value in total.items():
        flat = value.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(flat), pa.int32()), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
            names=["kind", "place", "value"],
        )


def fit(
    documents: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS
) -> Discriminant | None:
    """Fit on up to ``training_rows`` labelled documents outside the held-out fold.

    The driver gets the summed moments, some 350 numbers.  None if a class has no
    rows.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", 5) != 0))
    sample = labelled_sample(usable, "quality", training_rows)
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .select("text", F.col("label").cast("int").alias("label"))
        .transform(map_arrow, _moments, "kind int, place int, value double")
        .groupBy("kind", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    width = int(round(max((r["place"] for r in rows), default=-1) + 1) ** 0.5)
    sums = np.zeros((2, width * width))
    for r in rows:
        sums[r["kind"], r["place"]] = r["value"]
    sums = sums.reshape(2, width, width)
    if not width or (sums[:, 0, 0] < 2).any():
        return None
    n = sums[:, 0, 0]
    means = sums[:, 0, 1:] / n[:, None]
    scatter = [s[1:, 1:] / s[0, 0] - np.outer(m, m) for s, m in zip(sums, means)]
    pooled = np.diag(np.diag(n[0] * scatter[0] + n[1] * scatter[1]) / n.sum())
    factors, constants = [], []
    for k in (0, 1):
        covariance = (1 - SHRINKAGE) * scatter[k] + SHRINKAGE * pooled + RIDGE * np.eye(width - 1)
        lower = np.linalg.cholesky(covariance)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


def predict(documents: DataFrame, model: Discriminant | None, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``.

    A null or empty text is scored by its statistics (all counts 0).  Without a
    model every score is 0.5.  A null doc_id is not held out.  Columns besides
    doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, off in textops.pieces(batch.column("text")):
                rows = end - first
                score = np.full(rows, 0.5) if model is None else model.score(Stats(buf, off).features())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, rows),
                        batch.column("held_out").slice(first, rows),
                        pa.array(score),
                        pa.array((score >= cut).astype(np.int32)),
                    ],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return documents.select(
        F.col("doc_id").cast("long"), "text", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    ).transform(map_arrow, run, "doc_id long, held_out boolean, score double, predicted int")


def select_good(documents: DataFrame, model: Discriminant | None, cut: float = CUT) -> DataFrame:
    """The rows of ``documents`` that the model does not reject, with all columns;
    null texts are judged as empty ones, and without a model every row stays."""
    if model is None:
        return documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, off in textops.pieces(batch.column("text")):
                good = model.score(Stats(buf, off).features()) >= cut
                yield batch.slice(first, end - first).filter(pa.array(good))

    return documents.transform(map_arrow, run, documents.schema)


def quality_classifier(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows and score every row of ``documents``."""
    return predict(documents, fit(documents, labels))
