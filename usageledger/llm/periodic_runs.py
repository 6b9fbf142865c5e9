"""Periodic runs of words: found by common extensions, collapsed to one period.

A run is a maximal stretch of words with smallest period q whose length is at least
``max(LEAST_LENGTH, LEAST_EXPONENT * q)``.  For every q the text is probed at the grid 0,
q, 2q, ...: a run holds its first grid point less than q words after its start, so the
common extension of that point and the next one reaches over more than one period, and
the extension to the left gives the start.  That is n/q probes for each q, n log n in all.

Common extensions use a difference cover: only the suffixes at positions whose remainder
modulo 31 is in the cover are sorted; two positions are both in the cover after the same
step of at most 30 words, which are compared one by one, and the rest is a range minimum
over the common prefixes of sorted neighbours, answered by a sparse table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.llm import textops
from usageledger.llm.shipping import map_arrow

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
PIECE_BYTES = 2 << 20
PROBES = 1 << 19

#: A difference cover; each number is a difference of two members, modulo 31.
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)

_IN_COVER = np.zeros(MODULUS, bool)
_IN_COVER[list(COVER)] = True


def _steps() -> np.ndarray:
    """Least step after which positions with remainders r and r + d are in the cover."""
    out = np.full((MODULUS, MODULUS), MODULUS)
    for r in range(MODULUS):
        for d in range(MODULUS):
            good = [s for s in range(MODULUS) if _IN_COVER[(r + s) % MODULUS] and _IN_COVER[(r + d + s) % MODULUS]]
            out[r, d] = good[0]
    return out


_STEP = _steps()


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Rank of each row of the key columns, the first one most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Extensions:
    """Longest common extensions to the right in an array of word numbers, within the
    chosen positions.  The words end with a number that occurs once."""

    def __init__(self, words: np.ndarray, chosen: np.ndarray) -> None:
        self.words = words
        self.chosen = chosen

    @cached_property
    def _sorted(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Sample number of each position, rank of each sample, and the sparse table."""
        words, n = self.words, len(self.words)
        at = np.flatnonzero(self.chosen & _IN_COVER[np.arange(n) % MODULUS])
        number = np.full(n + MODULUS, -1)
        number[at] = np.arange(len(at))
        padded = np.r_[words + 1, np.zeros(MODULUS, np.int64)]
        bits = int(padded.max()).bit_length()
        together = max(1, 63 // bits)
        keys = []
        for first in range(0, MODULUS, together):
            key = np.zeros(len(at), np.int64)
            for k in range(first, min(first + together, MODULUS)):
                key = key << bits | padded[at + k]
            keys.append(key)
        levels = [_ranks(keys)]
        reach = MODULUS
        while len(at) and levels[-1].max() + 1 < len(at):
            following = self._number(number, at + reach)
            rank = np.where(following >= 0, levels[-1][following], -1)
            levels.append(_ranks([levels[-1] * (len(at) + 1) + rank + 1]))
            reach *= 2
        rank = levels[-1]
        order = np.argsort(rank)
        common = self._neighbours(at, order, number, levels)
        table, width = [common], 1
        while 2 * width <= len(common):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return number, rank, table

    @staticmethod
    def _number(number: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at < len(number), number[np.minimum(at, len(number) - 1)], -1)

    def _neighbours(
        self, at: np.ndarray, order: np.ndarray, number: np.ndarray, levels: list[np.ndarray]
    ) -> np.ndarray:
        """Common prefix of each sorted sample and the next one."""
        left, right = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(left), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            a, b = self._number(number, left + common), self._number(number, right + common)
            same = (a >= 0) & (b >= 0) & (levels[k][a] == levels[k][b])
            common += same * (MODULUS << k)
        return common + self._compare(left + common, right + common, np.full(len(left), MODULUS))[0]

    def _compare(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from i and j on, up to a limit each, and who reaches the limit."""
        length = np.zeros(len(i), np.int64)
        alive = np.arange(len(i))
        end = len(self.words)
        for k in range(MODULUS):
            alive = alive[limit[alive] > k]
            a, b = i[alive] + k, j[alive] + k
            inside = np.maximum(a, b) < end
            alive, a, b = alive[inside], a[inside], b[inside]
            alive = alive[self.words[a] == self.words[b]]
            if not len(alive):
                break
            length[alive] += 1
        return length, length == limit

    def first_words(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words before both positions are in the cover, and who gets there."""
        return self._compare(i, j, _STEP[i % MODULUS, (j - i) % MODULUS])

    def lengths(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of each pair of different positions."""
        length, synchronised = self.first_words(i, j)
        pair = np.flatnonzero(synchronised)
        if not len(pair):
            return length
        number, rank, table = self._sorted
        a, b = rank[number[i[pair] + length[pair]]], rank[number[j[pair] + length[pair]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            here = np.flatnonzero(level == k)
            row = table[k]
            length[pair[here]] += np.minimum(row[low[here]], row[high[here] - (1 << int(k))])
        return length


def _probes(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, grid position and period of every probe, in blocks."""
    periods = sizes // LEAST_EXPONENT * (sizes >= LEAST_LENGTH)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = (sizes[text] - 1) // period - 1
    ends = np.cumsum(count)
    for low in range(0, int(ends[-1]) if len(ends) else 0, PROBES):
        high = min(low + PROBES, int(ends[-1]))
        first, last = np.searchsorted(ends, [low, high - 1], "right")
        entry = np.arange(first, last + 1)
        begin = ends[entry] - count[entry]
        size = np.minimum(ends[entry], high) - np.maximum(begin, low)
        which = np.repeat(entry, size)
        k = np.arange(low, high) - (ends[which] - count[which])
        yield text[which], starts[text[which]] + k * period[which], period[which]


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each text, by start and then period.

    A text is an array of word numbers, which are not negative."""
    sizes = np.array([len(text) for text in texts], np.int64)
    mark = 1 + max((int(text.max()) for text in texts if len(text)), default=0)
    parts: list[np.ndarray] = [np.array([mark])]
    for k, text in enumerate(texts):
        parts += [text.astype(np.int64), np.array([mark + 1 + k])]
    words = np.concatenate(parts)
    starts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    plain = Extensions(words, np.zeros(0, bool))
    deep = np.zeros(len(texts), bool)
    found: list[np.ndarray] = []

    def enough(length: np.ndarray, q: np.ndarray) -> np.ndarray:
        return length >= np.maximum(q + 1, LEAST_LENGTH + 1 - 2 * q)

    def alike(text: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The first of the compared words: most probes end here."""
        near = np.flatnonzero(words[i] == words[i + q])
        return near[words[i[near] + 1] == words[i[near] + q[near] + 1]]

    for text, i, q in _probes(sizes, starts):
        near = alike(text, i, q)
        text, i, q = text[near], i[near], q[near]
        length, synchronised = plain.first_words(i, i + q)
        deep[text[synchronised]] = True
        good = ~synchronised & enough(length, q)
        found.append(np.column_stack([text, i, q, length])[good])

    def chosen(which: np.ndarray) -> np.ndarray:
        """Positions of some texts with the marks on both sides."""
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, starts[which] - 1, 1)
        np.add.at(edge, starts[which] + sizes[which] + 1, -1)
        return np.cumsum(edge)[:-1] > 0

    if deep.any():
        right = Extensions(words, chosen(np.flatnonzero(deep)))
        for text, i, q in _probes(np.where(deep, sizes, 0), starts):
            near = alike(text, i, q)
            text, i, q = text[near], i[near], q[near]
            length = right.lengths(i, i + q)
            found.append(_once(np.column_stack([text, i, q, length])[enough(length, q)], starts))
    probes = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    if not len(probes):
        return [np.empty((0, 3), np.int64) for _ in texts]
    text, i, q, length = probes.T
    last = len(words)
    left = Extensions(words[::-1].copy(), chosen(np.unique(text))[::-1].copy())
    first = i - np.concatenate(
        [left.lengths(last - i[k : k + PROBES], last - i[k : k + PROBES] - q[k : k + PROBES]) for k in range(0, len(i), PROBES)]
    )
    size = i + q + length - first
    good = size >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * q)
    text, first, size, q = text[good], first[good], size[good], q[good]
    # A run is found for multiples of its period too: the smallest one counts.
    order = np.lexsort([q, size, first])
    text, first, size, q = text[order], first[order], size[order], q[order]
    once = np.r_[True, (first[1:] != first[:-1]) | (size[1:] != size[:-1])] if len(first) else np.zeros(0, bool)
    rows = np.column_stack([first[once] - starts[text[once]], size[once], q[once]])
    text = text[once]
    order = np.lexsort([rows[:, 2], rows[:, 0], text])
    cuts = np.searchsorted(text[order], np.arange(len(texts) + 1))
    return [rows[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]


def _once(probes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Probes of one period with the same right end lie in the same run: one is enough."""
    if not len(probes):
        return probes
    end = probes[:, 1] + probes[:, 3]
    order = np.lexsort([probes[:, 1], end, probes[:, 2]])
    ranked, period = end[order], probes[order, 2]
    new = np.r_[True, (ranked[1:] != ranked[:-1]) | (period[1:] != period[:-1])]
    return probes[order[new]]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; then the smallest start and
    period."""
    if not len(runs):
        return None
    length, period = runs[:, 1], runs[:, 2]
    best = int(np.argmax(length / period))
    while (better := np.flatnonzero(length * period[best] > length[best] * period)).size:
        best = int(better[0])
    equal = np.flatnonzero(length * period[best] == length[best] * period)
    start, size, q = min(runs[equal].tolist(), key=lambda run: (run[0], run[2]))
    return start, size, q


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:-1] == 0


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the rows, and the offsets of each row's."""
    split = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
    words = split.flatten()
    full = np.asarray(pc.binary_length(words)) > 0
    offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
    return words.filter(pa.array(full)), np.r_[0, np.cumsum(full)][offsets]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _piece(doc_id: pa.Array, column: pa.Array) -> pa.RecordBatch:
    words, offsets = _words(column)
    numbers = np.asarray(words.dictionary_encode().indices) if len(words) else np.empty(0, np.int64)
    rows = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    runs = runs_of([numbers[a:b] for a, b in rows])
    kept = [kept_words(b - a, found) for (a, b), found in zip(rows, runs)]
    left = words.filter(pa.array(np.concatenate(kept))) if len(words) else words
    bounds = np.r_[0, np.cumsum([mask.sum() for mask in kept])]
    space = pa.scalar(" ", pa.large_string())
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), left), space)
    all_runs = np.concatenate(runs)
    counts = np.r_[0, np.cumsum([len(found) for found in runs])]
    structs = pa.StructArray.from_arrays([pa.array(c.copy()) for c in all_runs.T], fields=list(_RUN))
    best = [None if run is None else dict(zip(("start", "length", "period"), run)) for run in map(strongest, runs)]
    return pa.RecordBatch.from_arrays(
        [
            doc_id,
            pa.ListArray.from_arrays(pa.array(counts, pa.int32()), structs),
            pa.array(best, _RUN),
            collapsed.cast(pa.string()),
        ],
        names=["doc_id", "runs", "strongest", "collapsed"],
    )


def find_runs(documents: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period; by start and then period), strongest (the run
    with the greatest length / period, null without runs) and collapsed (the words that
    no run holds after its first period, joined by one space) for every row.

    Start and length count words.  A null or empty text has no runs and collapses to the
    empty string; repeated rows are treated one by one; a null doc_id stays null;
    columns besides doc_id and text are ignored.  A text is treated whole, in memory
    that grows with its words.
    """
    run_type = "struct<start:long,length:long,period:long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in textops.pieces(batch.column("text"), PIECE_BYTES):
                part = batch.slice(first, end - first)
                yield _piece(part.column("doc_id"), part.column("text"))

    schema = f"doc_id long, runs array<{run_type}>, strongest {run_type}, collapsed string"
    return documents.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, run, schema)


def damaged(doc_id: str, text: str) -> Column:
    """The text whose words repeat from a place on, where h = crc32(doc_id) ends in 0: with
    g = h div 10, n words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8), word i >= a
    becomes word a + (i - a) mod p.  Other texts, and those of a null doc_id, stay."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        cycle = F.slice(words, a + 1, p)
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise("")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != "")
    return F.when(
        (h % 10 == 0) & F.col(text).isNotNull(), F.element_at(F.transform(F.array(words), repeat), 1)
    ).otherwise(F.col(text))


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the strongest one, and digests of all runs and of what is left."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[name].alias(name) for name in ("start", "length", "period")),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
