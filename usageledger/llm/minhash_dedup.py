"""MinHash near-duplicates: multi-index Hamming join.

A text's set of 5-word shingles gives a signature of 45 min-hash symbols of 12
bits, cut to 9 chunks of 5.  If two signatures differ in at most 17 symbols, some
chunk differs in at most one (pigeonhole), so each chunk is indexed under its five
versions with one symbol left out: every pair within that distance shares a key.
At a similarity of 0.85 a distance over 17 has a probability below 1 in 10,000.
Pairs whose sets must differ too much are dropped by a parity sketch: every shingle
flips one of 512 bits, so two sketches differ in at most as many bits as the sets
differ in shingles.  The others are confirmed on the whole sets.

Equal sets are one class from the start.  Classes that share a key are first
compared with the smallest class of the key only; what that connects needs no more
comparison, and only classes of one key that are still apart are compared with
each other.  That gives the same components as comparing all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.llm import textops
from usageledger.llm.components import components
from usageledger.llm.shipping import map_arrow
from usageledger.session import materialize

WIDTH = 5
CHUNKS = 9
PER_CHUNK = 5
BITS = 12
DISTANCE = 2 * CHUNKS - 1
PERCENT = 85

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, CHUNKS * PER_CHUNK, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, CHUNKS * PER_CHUNK, dtype=np.uint64)
_FIELD = (1 << BITS) - 1
_LOW = sum((_FIELD >> 1) << (BITS * k) for k in range(PER_CHUNK))
_HIGH = sum((1 << (BITS - 1)) << (BITS * k) for k in range(PER_CHUNK))
PARITY_BITS = 512

_SIGNS = [f"s{c}" for c in range(CHUNKS)]
_PARITY = [f"o{c}" for c in range(PARITY_BITS // 64)]


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, by row and ascending, and their count per row."""
    rows = len(off) - 1
    buf = _LOWER[buf]
    starts, ends = textops.word_spans(buf, off)
    owner, words = textops.owners(starts, off)
    hashes = textops.span_hashes(buf, starts, ends)
    keys, at = textops.shingles(hashes, owner, WIDTH)
    row = owner[at]
    short = np.flatnonzero((words > 0) & (words < WIDTH))
    if len(short):
        first = np.cumsum(words) - words
        total = np.zeros(len(short), np.uint64)
        for k in range(WIDTH - 1):
            have = words[short] > k
            total[have] = textops.mix((total[have] + hashes[first[short[have]] + k]) * np.uint64(0xC2B2AE3D27D4EB4F))
        keys, row = np.r_[keys, textops.mix(total ^ words[short].astype(np.uint64))], np.r_[row, short]
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    return keys[new], np.bincount(row[new], minlength=rows)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, buf, off in textops.pieces(batch.column("text")):
            keys, count = shingle_sets(buf, off)
            filled = np.flatnonzero(count)
            begin = (np.cumsum(count) - count)[filled]
            parts = np.zeros((CHUNKS, end - first), np.uint64)
            sums = np.zeros((2, end - first), np.uint64)
            if len(filled):
                for i, salt in enumerate((0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D)):
                    sums[i, filled] = np.add.reduceat(textops.mix(keys ^ np.uint64(salt)), begin)
                for k in range(CHUNKS * PER_CHUNK):
                    low = np.minimum.reduceat(keys * _FACTORS[k] + _OFFSETS[k], begin)
                    symbol = textops.mix(low) & np.uint64(_FIELD)
                    parts[k // PER_CHUNK, filled] |= symbol << np.uint64(BITS * (k % PER_CHUNK))
            row = np.repeat(np.arange(end - first), count)
            place = row * PARITY_BITS + (keys >> np.uint64(55)).astype(np.int64)
            odd = np.bincount(place, minlength=PARITY_BITS * (end - first)) & 1
            words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
            columns = [*sums, *parts, *np.ascontiguousarray(words.reshape(-1, len(_PARITY)).T)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, end - first),
                    pa.array(count.astype(np.int64)),
                    *(pa.array(x.view(np.int64)) for x in columns),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", *_SIGNS, *_PARITY],
            )


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, size of the shingle set, two sums that name the set, the signature and
    the parity sketch."""
    schema = ", ".join(f"{name} long" for name in ("doc_id", "n_shingles", "h1", "h2", *_SIGNS, *_PARITY))
    return documents.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, _sketch, schema)


def _keys() -> Column:
    """The 45 keys of a signature: a chunk without one of its symbols."""
    return F.array(
        *(
            F.xxhash64(
                F.lit(c * PER_CHUNK + k),
                F.col(sign).bitwiseAND(F.lit(~(_FIELD << (BITS * k)))),
            )
            for c, sign in enumerate(_SIGNS)
            for k in range(PER_CHUNK)
        )
    )


def _distance(left: str, right: str) -> Column:
    """Symbols that differ between two signatures."""
    total = F.lit(0)
    for sign in _SIGNS:
        x = F.col(f"{left}.{sign}").bitwiseXOR(F.col(f"{right}.{sign}"))
        filled = (x.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(x).bitwiseAND(F.lit(_HIGH))
        total = total + F.bit_count(filled)
    return total


def _possible(left: str, right: str) -> Column:
    """Whether the signatures are within the distance and the sets may differ as
    little as the similarity asks for: by d shingles at most.  The bits that differ
    are at most d; where d is large, they are also at most six standard deviations
    over what d flips give on average."""
    bits = sum(
        (F.bit_count(F.col(f"{left}.{o}").bitwiseXOR(F.col(f"{right}.{o}"))) for o in _PARITY), F.lit(0)
    )
    d = (F.col(f"{left}.n_shingles") + F.col(f"{right}.n_shingles")) * (100 - PERCENT) / (100 + PERCENT)
    usual = PARITY_BITS / 2 * (1 - F.exp(d * math.log(1 - 2 / PARITY_BITS)))
    return (_distance(left, right) <= DISTANCE) & (bits <= F.least(d, usual + 3 * PARITY_BITS**0.5))


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that may reach the similarity."""
    return (
        pairs.alias("p")
        .join(classes.alias("x"), F.col("p.a") == F.col("x.rep"))
        .join(classes.alias("y"), F.col("p.b") == F.col("y.rep"))
        .where(_possible("x", "y"))
        .select("p.a", "p.b")
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, buf, off in textops.pieces(batch.column("text")):
            keys, count = shingle_sets(buf, off)
            stops = np.cumsum(count)
            sets = [keys[b - n : b].tobytes() for b, n in zip(stops, count)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, end - first), pa.array(sets, pa.binary())],
                names=["doc_id", "shingles"],
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for one, two in zip(batch.column("one"), batch.column("two")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, two))
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            good.append(100 * common >= PERCENT * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose whole sets reach the similarity."""
    return (
        pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("two")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("one")), "a")
        .select("a", "b", "one", "two")
        .transform(map_arrow, _confirm, "a long, b long")
    )


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``documents``.

    A text that is null or has no words has an empty set and links with nothing.  A
    null doc_id links with nothing: its component_id is null and it is kept.
    Rows of one doc_id are taken to repeat one text and share its component.  Columns besides doc_id and
    text are ignored.
    """
    found = materialize(sketches(documents), "sketches")
    usable = found.where("doc_id IS NOT NULL AND n_shingles > 0")
    same_set = ["h1", "h2", "n_shingles"]
    classes = materialize(
        usable.groupBy(*same_set).agg(
            F.min("doc_id").alias("rep"),
            F.count("*").alias("copies"),
            *(F.any_value(part).alias(part) for part in (*_SIGNS, *_PARITY)),
        ),
        "classes",
    )
    copies = (
        usable.select("doc_id", *same_set)
        .join(classes.where("copies > 1").select("rep", *same_set), same_set)
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    )
    keyed = classes.select("rep", F.explode(_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last")
    members = materialize(keyed.join(shared.select("key", "pivot"), "key"), "members")

    stars = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    stars = materialize(_near(stars, classes), "pairs")
    sets = materialize(
        documents.select(F.col("doc_id").cast("long"), "text")
        .join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .dropDuplicates(["doc_id"])
        .transform(map_arrow, _sets, "doc_id long, shingles binary"),
        "sets",
    )
    sure = materialize(_linked(stars, sets), "links")

    joined = components(sure)
    placed = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component_id", "rep").alias("part")
    )
    apart = placed.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y")
    rest = materialize(placed.join(apart.select("key"), "key").join(classes.drop("copies"), "rep"), "apart")
    one, two = rest.alias("x"), rest.alias("y")
    pairs = (
        one.join(
            two,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.rep") < F.col("y.rep"))
            & (F.col("x.part") != F.col("y.part"))
            & _possible("x", "y"),
        )
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    more = _linked(materialize(pairs, "pairs"), sets)
    whole = components(sure.union(more).union(copies))
    return (
        found.join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )
