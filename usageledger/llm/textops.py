"""Whole columns of text as byte arrays: words, lines and their hashes.

Everything works on the UTF-8 bytes of an Arrow batch, cut into pieces of a few
megabytes, so that memory is bounded by the piece or by the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
_BLOCK = 1 << 18
_LONG = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_POW = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_BLOCK + _LONG, _BASE, np.uint64)])
_INV = np.multiply.accumulate(
    np.r_[np.uint64(1), np.full(_BLOCK + _LONG, pow(_BASE, -1, 1 << 64), np.uint64)]
)

# The same with a prime modulus: strings can be built whose hashes modulo a power of two
# agree for every base.
_PRIME = (1 << 31) - 1
_PRIME_BASE = 0x2545F491


def _prime_powers(base: int) -> np.ndarray:
    """Powers of the base, by doubling."""
    out = np.ones(1, np.uint64)
    step = base % _PRIME
    while len(out) <= _BLOCK + _LONG:
        out = np.r_[out, out * np.uint64(step) % np.uint64(_PRIME)]
        step = step * step % _PRIME
    return out[: _BLOCK + _LONG + 1]


_PRIME_POW = _prime_powers(_PRIME_BASE)
_PRIME_INV = _prime_powers(pow(_PRIME_BASE, -1, _PRIME))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows have no bytes."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), off


def pieces(
    column: pa.Array, limit: int = PIECE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of up to ``limit`` bytes (a longer row on its own):
    first row, end row, bytes, offsets."""
    data, off = bytes_of(column)
    first, rows = 0, len(off) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        end = min(end, rows)
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; starts ascend.  Equal bytes, equal hash.

    Two polynomials, modulo 2 ** 64 and modulo a prime, are mixed; spans above 64 KiB have
    a cryptographic hash.
    """
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    long = size > _LONG
    for i in np.flatnonzero(long):
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    short = np.flatnonzero(~long)
    s, e = starts[short], ends[short]
    prime = np.uint64(_PRIME)
    cuts = np.r_[0, np.flatnonzero(np.diff(s // _BLOCK)) + 1, len(s)] if len(s) else np.array([0, 0])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        low, high = int(s[a]), int(e[a:b].max())
        first, last = s[a:b] - low, e[a:b] - low
        bytes_ = buf[low:high].astype(np.uint64) + np.uint64(1)
        sums = np.r_[np.uint64(0), np.cumsum(bytes_ * _POW[: high - low], dtype=np.uint64)]
        wide = (sums[last] - sums[first]) * _INV[first]
        # Terms are below 2 ** 40, so the sums of a block stay below 2 ** 59.
        sums = np.r_[np.uint64(0), np.cumsum(bytes_ * _PRIME_POW[: high - low], dtype=np.uint64)]
        narrow = (sums[last] - sums[first]) % prime * _PRIME_INV[first] % prime
        out[short[a:b]] = wide ^ mix(narrow + np.uint64(0xA24BAED4963EE407))
    return mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``; words end with their row."""
    solid = ~SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = off[1:-1]
    begins = inner[inner < len(buf)]
    first[begins] = solid[begins]
    stops = inner[inner > 0] - 1
    last[stops] = solid[stops]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owners(starts: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each position, and how many positions each row has."""
    counts = np.diff(np.searchsorted(starts, off))
    return np.repeat(np.arange(len(off) - 1), counts), counts


def sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a byte-wise mask per row."""
    out = np.zeros(len(off) - 1, np.int64)
    filled = np.flatnonzero(np.diff(off) > 0)
    if len(filled):
        out[filled] = np.add.reduceat(mask, off[:-1][filled], dtype=np.int64)
    return out


def shingles(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of one row, and the first word of each."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total = (total + hashes[at + k]) * np.uint64(0xD1342543DE82EF95)
        total ^= total >> np.uint64(29)
    return mix(total), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.r_[same, False] | np.r_[False, same] if len(keys) else same
    return out


def with_owner(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys that are equal only within a row."""
    return mix(keys ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
