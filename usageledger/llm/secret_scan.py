"""Secret scans: patterns, and novelty against a primed zstandard dictionary.

A string of 16 or more characters next to a sensitive word is a candidate: after an
operator or a quotation mark whatever it consists of, after a mere space if it has a
digit, as the next word of a sentence has none.  It is compressed with a
dictionary made of common identifiers and of the text around it, without copies of
the string itself; what it adds to the compressed size, against its length, is its
novelty.  Names, paths and words of the surrounding code compress well, random keys
do not, however often they stand there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageledger.llm import textops
from usageledger.llm.shipping import map_arrow

KINDS = ("assign", "access", "hex", "novel")
AROUND = 256
LEAST_NOVELTY = 0.7
LEVEL = 9
PLACEHOLDER = "[SECRET]"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_SENSITIVE = re.compile(
    r"(?:passw|passphrase|pwd|secret|token|credential|bearer|authorization|key|signature)"
    r"[A-Za-z_]{0,16}[\"'`)\]>]{0,2}[\x20\t]{0,4}"
    r"(?:(?:={1,3}(?![=>])|=>|:=|[:,(]|is\x20)[\x20\t]{0,4}[\"'`(]{0,2}(?:basic\x20|bearer\x20)?"
    r"|[\x20\t]{0,4}[\"'`(]{0,2}(?:basic\x20|bearer\x20)?(?<![A-Za-z0-9+/_=.-]))"  # else inside a word
    r"([A-Za-z0-9+/_=.-]{16,})",
    re.IGNORECASE | re.ASCII,
)
_OPERATOR = re.compile(r"[=:>(,\"'`]|\b(?:is|basic|bearer)\b", re.IGNORECASE)
_WORDS = ("pass", "pwd", "secret", "token", "credential", "bearer", "authorization", "key", "signature")
_IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 9876543210 "
    "00000000000000000000000000000000 xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx "
    "self this return function class public private static const import from true false null None "
    "string number value name type index length default example sample test config settings environment "
    "variable password username secret_key access_token api_key client_id client_secret your_token_here "
    "changeme placeholder insert_key_here http://www. https:// .com .org /usr/local/bin /home/user/ "
    "get_value set_value to_string from_string is_valid create_user update_record delete_item "
    "getElementById addEventListener toLowerCase application/json charset=utf-8 2024-01-01T00:00:00Z "
    "authentication authorization organization administration international implementation "
    "environment development production responsibility characteristics corresponding information "
).encode()
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True

Span = tuple[str, int, int]


def novelty(candidate: str, before: str, after: str) -> float:
    """Bytes that ``candidate`` adds to the compressed text, per byte."""
    around = _IDENTIFIERS + before.encode(errors="replace") + b"\n" + after.encode(errors="replace")
    primed = zstandard.ZstdCompressionDict(around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    data = candidate.encode()
    frame = len(compressor.compress(b""))
    return max(0, len(compressor.compress(data)) - frame) / len(data)


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """The text before and after a candidate, with its copies blanked: also those that
    an edge cuts, and those that lack punctuation at their ends."""
    core = text[start:end].strip("+/_=.-")
    blank, over = "\n" * len(core), len(core) - 1
    first = max(0, start - AROUND)
    low = max(0, first - over)
    return text[low:start].replace(core, blank)[first - low :], text[end : end + AROUND + over].replace(core, blank)[:AROUND]


def _novel(text: str, lowered: str) -> Iterator[Span]:
    if not any(word in lowered for word in _WORDS):
        return
    for match in _SENSITIVE.finditer(text):
        start, end = match.span(1)
        value = match[1]
        # In prose, with nothing but a space between, the next long word is no value.
        bare = text[start - 1 : start].isspace() and not _OPERATOR.search(match[0][: start - match.start()])
        if bare and not any(c.isdigit() for c in value):
            continue
        if novelty(value, *_around(text, start, end)) >= LEAST_NOVELTY:
            yield "novel", start, end


def find(text: str, hex_run: bool = True) -> list[Span]:
    """All spans of one text, by start and then kind, in code points.

    ``hex_run`` says whether the text may hold 32 hexadecimal digits in a row.
    """
    lowered = text.lower()
    spans: list[Span] = []
    if any(word in lowered for word in ("password", "passwd", "secret", "token", "api")):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if hex_run:
        spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    covered = [(start, end) for _, start, end in spans]
    for span in _novel(text, lowered):
        if not any(start < span[2] and span[1] < end for start, end in covered):
            spans.append(span)
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every found stretch replaced; overlapping spans become one."""
    out, done, last = [], 0, -1
    for _, start, end in sorted(spans, key=lambda span: span[1:]):
        if start >= last:
            out += [text[done:start], PLACEHOLDER]
        last = max(last, end)
        done = last
    return "".join([*out, text[done:]])


def _maybe_hex(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that touch a run of 32 hexadecimal digits."""
    other = np.flatnonzero(~_HEX_BYTE[buf])
    edges = np.r_[-1, other, len(buf)]
    at = np.flatnonzero(np.diff(edges) > 32)
    out = np.zeros(len(off) - 1, bool)
    for a, b in zip(edges[at] + 1, edges[at + 1]):
        out[np.searchsorted(off, a, "right") - 1 : np.searchsorted(off, b, "left")] = True
    return out


def _text_rows(column: pa.Array) -> Iterator[tuple[int, int, list[str | None], list[list[Span]]]]:
    for first, end, buf, off in textops.pieces(column):
        texts = column.slice(first, end - first).to_pylist()
        flags = _maybe_hex(buf, off)
        yield first, end, texts, [find(t, bool(h)) if t else [] for t, h in zip(texts, flags)]


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def secret_spans(documents: DataFrame) -> DataFrame:
    """doc_id and the found spans (kind, start, end) for every row of ``documents``.

    A null or empty text has no spans; repeated rows are scanned one by one;
    columns besides doc_id and text are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, found in _text_rows(batch.column("text")):
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(rows, kind)],
                    names=["doc_id", "spans"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").transform(
        map_arrow,
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def redact_secrets(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with every found secret replaced by a placeholder; a null text
    stays null, all other columns and rows stay as they are."""
    place = documents.columns.index(text)
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts, found in _text_rows(batch.column(place)):
                part = batch.slice(first, end - first)
                clean = [redact(t, s) if s else t for t, s in zip(texts, found)]
                yield part.set_column(place, text, pa.array(clean, part.column(place).type))

    return documents.transform(map_arrow, run, schema)


def digests(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )
