"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens.
Tier two: other pre-tokens are merged with a heap of pairs over a linked list of
bytes.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageledger.llm import textops
from usageledger.llm.shipping import map_arrow

PIECE_BYTES = 1 << 20
CACHE_ENTRIES = 800_000
_RANK_BITS = 24


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _hash_all(keys: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(keys), np.uint8)
    return textops.span_hashes(buf, ends - sizes, ends)


class PerfectHash:
    """Minimal perfect hash of byte strings: a displacement for each small group of
    keys sends every key to a slot of its own among ``len(keys)`` slots.  A group of
    one key names its slot itself, as -1 - slot."""

    def __init__(self, keys: list[bytes]) -> None:
        self.size = len(keys)
        self.groups = max(1, self.size // 3)
        hashes = _hash_all(keys)
        group = self._group(hashes)
        self.displacement = np.zeros(self.groups, np.int64)
        self.keys: list[bytes] = [b""] * self.size
        self.ranks = np.zeros(self.size, np.int64)
        taken = np.zeros(self.size, bool)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.groups + 1))
        tries = np.arange(512)
        for g in np.argsort(-np.diff(cuts), kind="stable"):
            members = order[cuts[g] : cuts[g + 1]]
            if len(members) < 2:
                break
            base = 0
            while True:
                slots = self._slot(hashes[members][None, :], (base + tries)[:, None])
                ranked = np.sort(slots, axis=1)
                good = ~taken[slots].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if len(hit):
                    self.displacement[g] = base + hit[0]
                    taken[slots[hit[0]]] = True
                    for slot, member in zip(slots[hit[0]], members):
                        self.keys[slot], self.ranks[slot] = keys[member], member
                    break
                base += len(tries)
                if base > 1 << 24:
                    raise ValueError("two tokens with the same bytes")
        alone = np.flatnonzero(np.diff(cuts) == 1)
        for g, slot in zip(alone, np.flatnonzero(~taken)):
            member = order[cuts[g]]
            self.displacement[g] = -1 - slot
            self.keys[slot], self.ranks[slot] = keys[member], member

    def _group(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.groups)).astype(np.int64)

    def _slot(self, hashes: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        step = (displacement.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return (textops.mix(hashes + step) % np.uint64(self.size)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> list[int]:
        """Rank of each key, -1 for strings outside the vocabulary."""
        if not keys or not self.size:
            return [-1] * len(keys)
        hashes = _hash_all(keys)
        moved = self.displacement[self._group(hashes)]
        slots = np.where(moved < 0, -1 - moved, self._slot(hashes, moved))
        ranks = self.ranks[slots].tolist()
        return [r if self.keys[s] == k else -1 for s, r, k in zip(slots.tolist(), ranks, keys)]


def pair_table(tokens: list[bytes]) -> dict[int, int]:
    """Rank of the token that two adjacent tokens make, by both of their ranks."""
    rank_of = {token: rank for rank, token in enumerate(tokens)}
    table = {}
    for rank, token in enumerate(tokens):
        for cut in range(1, len(token)):
            left, right = rank_of.get(token[:cut]), rank_of.get(token[cut:])
            if left is not None and right is not None:
                table[left << _RANK_BITS | right] = rank
    return table


def merge(piece: bytes, byte_ranks: list[int], pairs: dict[int, int]) -> tuple[int, ...]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is left.

    Parts are linked by the places of their first bytes; a heap entry is a rank and
    a place, and is skipped if the parts there no longer make that rank.
    """
    parts = [byte_ranks[b] for b in piece]
    end = len(parts)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    shift = end.bit_length()
    mask = (1 << shift) - 1
    heap = []
    for i in range(end - 1):
        rank = pairs.get(parts[i] << _RANK_BITS | parts[i + 1])
        if rank is not None:
            heap.append(rank << shift | i)
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry & mask
        j = after[i]
        if parts[i] < 0 or j == end:
            continue
        rank = pairs.get(parts[i] << _RANK_BITS | parts[j])
        if rank != entry >> shift:
            continue
        parts[i], parts[j] = rank, -1
        k, h = after[j], before[i]
        after[i] = k
        if k != end:
            before[k] = i
            new = pairs.get(rank << _RANK_BITS | parts[k])
            if new is not None:
                heappush(heap, new << shift | i)
        if h >= 0:
            new = pairs.get(parts[h] << _RANK_BITS | rank)
            if new is not None:
                heappush(heap, new << shift | h)
    return tuple(part for part in parts if part >= 0)


@dataclass
class Codec:
    """Vocabulary (with all single bytes), its perfect hash and the pattern that cuts
    text to pre-tokens."""

    tokens: list[bytes]
    pattern: str
    table: PerfectHash = field(init=False)

    def __post_init__(self) -> None:
        self.table = PerfectHash(self.tokens)
        self._ready = False

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "pattern": self.pattern, "table": self.table, "_ready": False}

    def _prepare(self) -> None:
        if not self._ready:
            self._find = regex.compile(self.pattern).findall
            rank_of = {token: rank for rank, token in enumerate(self.tokens)}
            self._bytes = [rank_of[bytes([b])] for b in range(256)]
            self._pairs = pair_table(self.tokens)
            self._seen: dict[str, tuple[int, ...]] = {}
            self._ready = True

    def encode_many(self, texts: Iterable[str]) -> list[list[int]]:
        """Token ids of each text."""
        self._prepare()
        cut = [self._find(text) for text in texts]
        new = list(set(chain.from_iterable(cut)).difference(self._seen))
        if len(self._seen) + len(new) > CACHE_ENTRIES:
            self._seen = {}
            new = list(set(chain.from_iterable(cut)))
        raw = [piece.encode() for piece in new]
        for piece, data, rank in zip(new, raw, self.table.lookup(raw)):
            self._seen[piece] = (rank,) if rank >= 0 else merge(data, self._bytes, self._pairs)
        return [list(chain.from_iterable(map(self._seen.__getitem__, pieces))) for pieces in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _apply(documents: DataFrame, codec: Codec, schema: str, outputs) -> DataFrame:
    """``outputs`` gives the columns besides doc_id of one text's ids and bytes."""
    shared = documents.sparkSession.sparkContext.broadcast(codec)
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    kinds = [types[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for first, end, _, _ in textops.pieces(batch.column("text"), PIECE_BYTES):
                texts = [t or "" for t in batch.column("text").slice(first, end - first).to_pylist()]
                rows = [outputs(ids, codec.decode(ids)) for ids in codec.encode_many(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first),
                        *(pa.array(column, kind) for column, kind in zip(zip(*rows), kinds[1:])),
                    ],
                    names=names,
                )

    return documents.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, run, schema)


def encode(documents: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, ids and decoded bytes of every row; a null text has no ids."""
    return _apply(
        documents, codec, "doc_id long, ids array<int>, decoded binary", lambda ids, data: (ids, data)
    )


def encode_digests(documents: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded bytes."""
    texts = [str(i) for i in range(len(codec.tokens))]

    def digests(ids: list[int], data: bytes) -> tuple[int, str, str]:
        joined = ",".join(map(texts.__getitem__, ids))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(data).hexdigest()

    return _apply(
        documents, codec, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests
    )
