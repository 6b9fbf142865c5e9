"""Language identification: a byte convolutional network in numpy.

A byte embedding, filters of width 2, 3 and 4, maximum over a fixed-length window,
softmax.  Applying it, the embedding and the filters are folded into tables of
byte pairs, which gives the same sums with fewer operations.  A text is judged by
all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageledger.llm import textops
from usageledger.llm.sampling import fold
from usageledger.llm.shipping import map_arrow

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBEDDING = 8
FILTERS = 16
ROWS_PER_LANGUAGE = 600
LANGUAGES = 256
WINDOWS_PER_ROW = 2
STEPS = 600
BATCH = 64
LETTER = r"\p{L}"
UNDETERMINED = "und"
LEAST_LOG = -6.0


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Response of each filter half to each byte pair (first byte low)."""
        single = [[self.embedding @ w[k] for k in range(len(w))] for w in self.filters]
        pair = lambda a, b: (b[:, None, :] + a[None, :, :]).reshape(65536, -1)
        two, three, four = single
        return [
            pair(two[0], two[1]),
            pair(three[0], three[1]),
            three[2],
            pair(four[0], four[1]),
            pair(four[2], four[3]),
        ], np.concatenate(self.biases)


def _windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows, padded with byte 0: bytes, row, filled length."""
    size = np.diff(off)
    per_row = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), per_row)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = off[:-1][row] + rank * WINDOW
    filled = np.minimum(off[1:][row] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < filled[:, None]
    out = np.where(inside, buf[np.minimum(at, max(len(buf) - 1, 0))], 0) if len(row) else at.astype(np.uint8)
    return out.astype(np.uint8), row, filled


def _pooled(windows: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Maximum of every filter over each window, rectified."""
    one = windows.astype(np.int32)
    two = one[:, :-1] | one[:, 1:] << 8
    a = tables[0][two].max(axis=1)
    b = tables[1][two[:, :-1]]
    b += tables[2][one[:, 2:]]
    c = tables[3][two[:, :-2]]
    c += tables[4][two[:, 2:]]
    return np.maximum(np.concatenate([a, b.max(axis=1), c.max(axis=1)], axis=1) + bias, 0)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on the cross entropy of windows; ``target`` holds places in ``languages``."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.5, (256, EMBEDDING))]
    params += [rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages))]
    moment = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    k = len(WIDTHS)
    for step in range(1, STEPS + 1):
        chosen = rng.integers(0, len(windows), BATCH)
        x, y = windows[chosen].astype(int), target[chosen]
        # Half of the windows are cut short, as the last window of a text is.
        size = np.where(rng.random(BATCH) < 0.5, rng.integers(8, WINDOW, BATCH), WINDOW)
        x[np.arange(WINDOW) >= size[:, None]] = 0
        emb, filters, biases, out, out_bias = params[0], params[1 : 1 + k], params[1 + k : 1 + 2 * k], *params[-2:]
        e = emb[x]
        best, hidden = [], []
        for w, f, b in zip(WIDTHS, filters, biases):
            n = WINDOW - w + 1
            response = sum(e[:, j : j + n] @ f[j] for j in range(w))
            best.append(response.argmax(axis=1))
            hidden.append(np.take_along_axis(response, best[-1][:, None, :], 1)[:, 0] + b)
        pre = np.concatenate(hidden, axis=1)
        act = np.maximum(pre, 0)
        delta = np.exp(_log_softmax(act @ out + out_bias))
        delta[np.arange(BATCH), y] -= 1
        delta /= BATCH
        grads: list[np.ndarray] = [np.zeros_like(p) for p in params]
        grads[-2], grads[-1] = act.T @ delta, delta.sum(axis=0)
        back = (delta @ out.T) * (pre > 0)
        rows = np.arange(BATCH)[:, None]
        for i, (w, f) in enumerate(zip(WIDTHS, filters)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            grads[1 + k + i] = g.sum(axis=0)
            for j in range(w):
                at = best[i] + j
                grads[1 + i][j] = np.einsum("bfe,bf->ef", e[rows, at], g)
                np.add.at(grads[0], x[rows, at], g[:, :, None] * f[j].T[None])
        for i, g in enumerate(grads):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            rate = 0.01 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
            params[i] = params[i] - rate
    single = [p.astype(np.float32) for p in params]
    return Network(languages, single[0], single[1 : 1 + k], single[1 + k : 1 + 2 * k], single[-2], single[-1])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evenly spaced windows of each text."""
    for batch in batches:
        for first, end, buf, off in textops.pieces(batch.column("text")):
            windows, row, _ = _windows(buf, off)
            counts = np.bincount(row, minlength=end - first)
            begin = np.cumsum(counts) - counts
            full = np.flatnonzero(counts)
            parts = np.arange(WINDOWS_PER_ROW)[None, :] * counts[full, None] // WINDOWS_PER_ROW
            at = np.unique(begin[full, None] + parts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, end - first).take(pa.array(row[at])),
                    batch.column("lang").slice(first, end - first).take(pa.array(row[at])),
                    pa.array([windows[i].tobytes() for i in at], pa.binary()),
                ],
                names=["doc_id", "lang", "window"],
            )


def fit(
    documents: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, languages_at_most: int = LANGUAGES
) -> Network | None:
    """Train on about ``rows_per_language`` texts of each language outside the
    held-out fold (all texts of a language with fewer), ``WINDOWS_PER_ROW`` windows
    each.  Of more than ``languages_at_most`` values of lang the most frequent are learned
    (ties: the smaller), so that a dirty column does not fill the driver.  None if there
    is nothing to learn from."""
    usable = documents.select("doc_id", "text", "lang").where(
        (fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    frequent = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages_at_most)
    counts = {r["lang"]: r["count"] for r in frequent.collect()}
    if not counts:
        return None
    share = F.create_map(
        *(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows_per_language / n)))
    )
    spread = (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) + 0.5) / 1_000_003
    rows = (
        usable.where(spread < share[F.col("lang")])
        .transform(map_arrow, _sampled, "doc_id long, lang string, window binary")
        .orderBy("doc_id", "window")
        .collect()
    )
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    place = {lang: i for i, lang in enumerate(languages)}
    return train(windows, np.array([place[r["lang"]] for r in rows]), languages)


def predict(documents: DataFrame, model: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``documents``.

    The log probabilities of all windows are averaged, weighted by their length; they
    are bounded below, so that a passage in another language counts by its share.
    A text that is null or has no letter, and any text without a model, gives
    ``und`` with score 0.  A null doc_id is not held out.
    """
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    tables, bias = model.tables() if model else ([], np.empty(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            for first, end, buf, off in textops.pieces(batch.column("text")):
                rows = end - first
                names: list[str] = [UNDETERMINED] * rows
                score = np.zeros(rows)
                if model:
                    windows, row, filled = _windows(buf, off)
                    total = np.zeros((rows, len(model.languages)))
                    for a in range(0, len(windows), 512):
                        part = slice(a, a + 512)
                        logits = _pooled(windows[part], tables, bias) @ model.out + model.out_bias
                        logs = np.maximum(_log_softmax(logits), LEAST_LOG)
                        np.add.at(total, row[part], logs * filled[part, None])
                    prob = np.exp(_log_softmax(total / np.maximum(np.diff(off), 1)[:, None]))
                    best = prob.argmax(axis=1)
                    known = letters[first:end]
                    score = np.where(known, np.round(prob[np.arange(rows), best], 6), 0.0)
                    names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, rows),
                        batch.column("held_out").slice(first, rows),
                        pa.array(names, pa.string()),
                        pa.array(score),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return documents.select(
        F.col("doc_id").cast("long"),
        "text",
        F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("letters"),
    ).transform(map_arrow, run, schema)


def language_id(documents: DataFrame) -> DataFrame:
    """Train on the labelled texts and predict every row of ``documents``."""
    return predict(documents, fit(documents))
