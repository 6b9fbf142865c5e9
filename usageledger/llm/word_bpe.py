"""BPE with word ends: encoding by tree concatenation, and decoding.

A text is cut to words after normalisation.  A short word is merged as a whole.  A long
unsplit one is halved until the halves are short; halves are encoded on their own, and
the tokens around each join are encoded again, in windows that double until the outer
token of the window is the old one on both sides.  That is exact: a token sequence is
the encoding of its text if and only if each adjacent pair of tokens is the encoding of
the pair's text, and an agreeing window leaves no pair unchecked.

The halves of very long words are encoded by different tasks; only the joins are made
in the task that gathers a document's ids.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageledger.llm import textops
from usageledger.llm.shipping import map_arrow
from usageledger.session import materialize

PIECE_BYTES = 1 << 20
CACHE_ENTRIES = 600_000
#: Symbols of a leaf: words up to this length are merged as a whole.
LEAF = 256
#: Bytes of a word from which its stretches go to different tasks, and of a stretch.
SPREAD = 1 << 18
STRETCH = 1 << 16
_SHIFT = 24

# Lower case of letters that are newer than the interpreter's tables, as
# first code point, last code point, step from upper to lower case.
_NEWER_CASE = (
    (0x1C89, 0x1C89, 0x1),
    (0xA7CB, 0xA7CB, 0x264 - 0xA7CB),
    (0xA7CC, 0xA7CC, 0x1),
    (0xA7CE, 0xA7CE, 0x1),
    (0xA7D2, 0xA7D2, 0x1),
    (0xA7D4, 0xA7D4, 0x1),
    (0xA7DA, 0xA7DA, 0x1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20),
    (0x16EA0, 0x16EB8, 0x1B),
)
# Letters and digits of Unicode 16.0, as first and last code point; the
# tokenizers library knows them, and none of a later version.
_NEWER_LETTERS = (
    (0x1C89, 0x1C8A),
    (0xA7CB, 0xA7CD),
    (0xA7DA, 0xA7DC),
    (0x105C0, 0x105F3),
    (0x10D40, 0x10D65),
    (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4),
    (0x11380, 0x11389),
    (0x1138B, 0x1138B),
    (0x1138E, 0x1138E),
    (0x11390, 0x113B5),
    (0x113B7, 0x113B7),
    (0x113D1, 0x113D1),
    (0x113D3, 0x113D3),
    (0x116D0, 0x116E3),
    (0x11BC0, 0x11BE0),
    (0x11BF0, 0x11BF9),
    (0x13460, 0x143FA),
    (0x16100, 0x1611D),
    (0x16130, 0x16139),
    (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79),
    (0x18CFF, 0x18CFF),
    (0x1CCF0, 0x1CCF9),
    (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5FA),
)
_LOWER = {cp: chr(cp + step) for first, last, step in _NEWER_CASE for cp in range(first, last + 1)}
_LOWER |= {0x3A3: "σ"}  # the sigma of a word's end is not told apart


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if it is a visible
    Latin-1 character, else the next one from U+0100."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    other = iter(range(256, 512))
    return [chr(b) if b in set(visible) else chr(next(other)) for b in range(256)]


def _unassigned_letters() -> str:
    """Ranges of code points that the regex module takes for letters or digits and that
    the tokenizers library does not know, as the inside of a character class."""
    known = {cp for first, last in _NEWER_LETTERS for cp in range(first, last + 1)}
    every = "".join(map(chr, [*range(0x378, 0xD800), *range(0xE000, sys.maxunicode + 1)]))
    ranges: list[list[int]] = []
    for letter in regex.findall(r"[\p{L}\p{N}]", every):
        cp = ord(letter)
        if unicodedata.category(letter) != "Cn" or cp in known:
            continue
        if ranges and cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(f"\\U{first:08x}-\\U{last:08x}" for first, last in ranges)


def merge(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is left.

    ``pairs`` gives rank and made token, as ``rank << 24 | token``, of ``left << 24 | right``.
    """
    end = len(symbols)
    if end < 2:
        return list(symbols)
    parts = list(symbols)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    bits = end.bit_length()
    place = (1 << bits) - 1
    queue = [
        made << bits | i
        for i in range(end - 1)
        if (made := pairs.get(parts[i] << _SHIFT | parts[i + 1])) is not None
    ]
    heapify(queue)
    while queue:
        entry = heappop(queue)
        i, made = entry & place, entry >> bits
        j = after[i]
        if parts[i] < 0 or j == end or pairs.get(parts[i] << _SHIFT | parts[j]) != made:
            continue
        parts[i], parts[j] = made & ((1 << _SHIFT) - 1), -1
        after[i] = following = after[j]
        if following != end:
            before[following] = i
            new = pairs.get(parts[i] << _SHIFT | parts[following])
            if new is not None:
                heappush(queue, new << bits | i)
        leading = before[i]
        if leading >= 0:
            new = pairs.get(parts[leading] << _SHIFT | parts[i])
            if new is not None:
                heappush(queue, new << bits | leading)
    return [part for part in parts if part >= 0]


@dataclass
class WordCodec:
    """Vocabulary, merges and the texts of added tokens."""

    tokens: list[str]
    merges: list[tuple[str, str]]
    added: dict[str, int]
    pattern: str
    suffix: str
    unknown: str

    def __post_init__(self) -> None:
        self._ready = False

    def __getstate__(self) -> dict:
        names = ("tokens", "merges", "added", "pattern", "suffix", "unknown")
        return {name: getattr(self, name) for name in names} | {"_ready": False}

    def _prepare(self) -> None:
        if self._ready:
            return
        self._id = {token: i for i, token in enumerate(self.tokens)}
        letters = _byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self._inner = [self._id[letter] for letter in letters]
        self._last = [self._id[letter + self.suffix] for letter in letters]
        self._pairs = {
            self._id[left] << _SHIFT | self._id[right]: rank << _SHIFT | self._id[left + right]
            for rank, (left, right) in enumerate(self.merges)
        }
        self._symbols: list[list[int]] = []
        for token in self.tokens:
            ends = token.endswith(self.suffix)
            raw = [byte_of.get(c, 0) for c in (token[: -len(self.suffix)] if ends else token)]
            symbols = [self._inner[b] for b in raw]
            if ends and raw:
                symbols[-1] = self._last[raw[-1]]
            self._symbols.append(symbols)
        self._find = regex.compile(self.pattern).findall
        strict = self.pattern
        if self.unknown:
            strict = strict.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{self.unknown}])")
            strict = strict.replace(r"[\p{L}]", rf"(?:(?![{self.unknown}])\p{{L}})")
            strict = strict.replace(r"[\p{N}]", rf"(?:(?![{self.unknown}])\p{{N}})")
        self._find_strictly = regex.compile(strict).findall
        self._has_unknown = regex.compile(f"[{self.unknown}]").search if self.unknown else lambda word: None
        names = sorted(self.added, key=len, reverse=True)
        self._cut_added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else lambda t: [t]
        self._seen: dict[str, bytes] = {}
        self._ready = True

    def normalise(self, text: str) -> str:
        """NFC in lower case; white space only separates, so it may stay."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).translate(_LOWER).lower()

    def words(self, text: str) -> list[str]:
        """The words of one stretch of ordinary text."""
        text = self.normalise(text)
        found = self._find(text)
        for word in set(found).difference(self._seen):
            if not word.isascii() and self._has_unknown(word):
                return self._find_strictly(text)
        return found

    # -- words ----------------------------------------------------------------

    def symbols(self, data: bytes, ends: bool) -> list[int]:
        """One symbol a byte; the last one carries the word end, if it is there."""
        out = [self._inner[b] for b in data]
        if ends and out:
            out[-1] = self._last[data[-1]]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two adjacent stretches from the encodings of both."""
        if not left or not right:
            return left + right
        size = 1
        while True:
            a, b = left[-size:], right[:size]
            window = merge([s for token in a + b for s in self._symbols[token]], self._pairs)
            left_agrees = len(a) == len(left) or window[0] == a[0]
            right_agrees = len(b) == len(right) or window[-1] == b[-1]
            if left_agrees and right_agrees:
                return left[: len(left) - len(a)] + window + right[len(b) :]
            size *= 2

    def concatenate(self, parts: list[list[int]]) -> list[int]:
        """Join the encodings of adjacent stretches, neighbours first."""
        while len(parts) > 1:
            joined = [self.join(parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(parts) & ~1 :]
        return parts[0] if parts else []

    def encode_stretch(self, data: bytes, ends: bool) -> list[int]:
        """Ids of a word, or of a stretch of one."""
        self._prepare()
        symbols = self.symbols(data, ends)
        leaves = range(0, len(symbols), LEAF)
        return self.concatenate([merge(symbols[k : k + LEAF], self._pairs) for k in leaves])

    def _ids(self, word: str) -> bytes:
        known = self._seen.get(word)
        if known is not None:
            return known
        ids = np.array(self.encode_stretch(word.encode(), True), "<u4").tobytes()
        if len(word) <= LEAF and not (not word.isascii() and self._has_unknown(word)):
            if len(self._seen) >= CACHE_ENTRIES:
                self._seen = {}
            self._seen[word] = ids
        return ids

    # -- texts ------------------------------------------------------------------

    def parts(self, text: str, spread: int = SPREAD) -> list[tuple[bytes | None, bytes, bool]]:
        """Ids of a text as little-endian 32-bit numbers, in order; where a word has
        ``spread`` bytes or more, its stretches instead: (None, bytes, whether it ends)."""
        self._prepare()
        out: list[tuple[bytes | None, bytes, bool]] = []
        ready: list[bytes] = []
        for k, section in enumerate(self._cut_added(text)):
            if k % 2:
                ready.append(self.added[section].to_bytes(4, "little"))
                continue
            words = self.words(section)
            if len(section) * 4 < spread or max(map(len, words), default=0) * 4 < spread:
                ready += map(self._ids, words)
                continue
            for word in words:
                data = word.encode()
                if len(data) < spread:
                    ready.append(self._ids(word))
                    continue
                out.append((b"".join(ready), b"", False))
                ready = []
                for at in range(0, len(data), STRETCH):
                    out.append((None, data[at : at + STRETCH], at + STRETCH >= len(data)))
        out.append((b"".join(ready), b"", False))
        return out

    def encode(self, text: str) -> list[int]:
        ((ids, _, _),) = self.parts(text, sys.maxsize)
        return np.frombuffer(ids, "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens, with one space between two; added tokens are kept."""
        return " ".join(map(self._names().__getitem__, ids))

    def _names(self) -> list[str]:
        if not hasattr(self, "_all"):
            size = max([len(self.tokens) - 1, *self.added.values()]) + 1
            self._all = self.tokens + [""] * (size - len(self.tokens))
            for text, i in self.added.items():
                self._all[i] = text
        return self._all


def load(path: str) -> WordCodec:
    """The codec of a tokenizer file; anything but the steps this module has raises."""
    with open(path, encoding="utf-8") as lines:
        spec = json.load(lines)
    model = spec["model"]
    steps = [step["type"] for step in spec["normalizer"]["normalizers"]]
    split, letters = spec["pre_tokenizer"]["pretokenizers"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))
    if (
        steps != ["NFC", "Replace", "Lowercase"]
        or (split["behavior"], split["invert"], letters["type"]) != ("Removed", True, "ByteLevel")
        or (letters["add_prefix_space"], letters["use_regex"]) != (False, False)
        or spec["decoder"] is not None
        or spec["post_processor"] is not None
        or not plain
        or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    ):
        raise ValueError(f"{path}: not a tokenizer of this kind")
    tokens = [""] * (max(model["vocab"].values()) + 1)
    for token, i in model["vocab"].items():
        tokens[i] = token
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if len({left + right for left, right in merges}) != len(merges):
        raise ValueError(f"{path}: a token that two merges make")
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return WordCodec(
        tokens, merges, added, split["pattern"]["Regex"], model["end_of_word_suffix"], _unassigned_letters()
    )


def _apply(
    documents: DataFrame, codec: WordCodec, fields: str, outputs: Callable[[bytes, WordCodec], tuple], spread: int
) -> DataFrame:
    """doc_id and ``outputs`` of every row's ids."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(codec)
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    names = [field.split()[0] for field in fields.split(", ")]
    kinds = [types[field.split()[1]] for field in fields.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for first, end, _, _ in textops.pieces(batch.column("text"), PIECE_BYTES):
                part = batch.slice(first, end - first)
                done, spans = [], []
                for row, doc_id, text in zip(*(part.column(n).to_pylist() for n in ("row", "doc_id", "text"))):
                    pieces = codec.parts(text or "", spread)
                    if len(pieces) == 1:
                        done.append((doc_id, row, None, None, None, False, *outputs(pieces[0][0], codec)))
                    else:
                        spans += [(doc_id, row, k, *piece, *[None] * len(kinds)) for k, piece in enumerate(pieces)]
                columns = zip(*(done + spans))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, [*part_kinds, *kinds])], names=[*part_names, *names]
                )

    part_kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
    part_names = ["doc_id", "row", "part", "part_ids", "stretch", "ends"]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                data = part.column("stretch")[0].as_py()
                if data is not None and part.column("part_ids")[0].as_py() is None:
                    ids = np.array(codec.encode_stretch(data, part.column("ends")[0].as_py()), "<u4").tobytes()
                    part = part.set_column(3, "part_ids", pa.array([ids], pa.binary()))
                yield part

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        codec._prepare()
        row, doc_id, ready, open_word = None, None, [], []

        def finish() -> pa.RecordBatch:
            values = [(doc_id,), *([v] for v in outputs(b"".join(ready), codec))]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(values, [pa.int64(), *kinds])], names=["doc_id", *names]
            )

        for batch in batches:
            for part in batch.to_pylist():
                if part["row"] != row:
                    if row is not None:
                        yield finish()
                    row, doc_id, ready, open_word = part["row"], part["doc_id"], [], []
                if not part["stretch"]:
                    ready.append(part["part_ids"])
                    continue
                open_word.append(np.frombuffer(part["part_ids"], "<u4").tolist())
                if part["ends"]:
                    ready.append(np.array(codec.concatenate(open_word), "<u4").tobytes())
                    open_word = []
        if row is not None:
            yield finish()

    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    part_schema = "doc_id long, row long, part long, part_ids binary, stretch binary, ends boolean"
    found = materialize(map_arrow(rows, encode, f"{part_schema}, {fields}"), "word-bpe")
    long_rows = found.where("part IS NOT NULL").select(part_schema.replace(",", "").split()[::2])
    encoded = map_arrow(long_rows.repartition("row", "part"), stretches, part_schema)
    ordered = encoded.repartition("row").sortWithinPartitions("row", "part")
    gathered = map_arrow(ordered, gather, f"doc_id long, {fields}")
    return found.where("part IS NULL").select("doc_id", *names).unionByName(gathered)


def encode(documents: DataFrame, codec: WordCodec, spread: int = SPREAD) -> DataFrame:
    """doc_id, ids and decoded text of every row.

    A null text counts as empty and has no ids; repeated rows are encoded one by one, a
    null doc_id stays null; columns besides doc_id and text are ignored.
    """

    def outputs(ids: bytes, codec: WordCodec) -> tuple:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return numbers, codec.decode(numbers)

    return _apply(documents, codec, "ids array<int>, decoded string", outputs, spread)


def digests(documents: DataFrame, codec: WordCodec, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded text, with the
    cases of ``encode``."""

    def outputs(ids: bytes, codec: WordCodec) -> tuple:
        numbers = np.frombuffer(ids, "<u4").tolist()
        decoded = codec.decode(numbers).encode()
        return len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _apply(documents, codec, "n_tokens long, ids_sha256 string, decoded_sha256 string", outputs, spread)
