"""Removal of repeated byte strings with a run-length index.

Every byte covered by a 100-byte window that also starts earlier in the corpus is
removed.  Windows are dealt out by content: a window belongs to its minimizer, the
32-byte gram with the least hash among its 69 grams, so equal windows meet at the
gram they share, at the same offset.  The neighbouring windows of one gram form a
stretch of 100 to 168 bytes.

0. Grams that very many different stretches share are found first, by counts alone:
   each task counts what it reads, the counts of a place (24 bits of the gram's hash) are
   summed, and the crowded places go to all tasks as 2 MB of bits at most.
1. Each task finds grams and stretches, collapses equal stretches, and sends their
   hashes out by gram, packed by bucket.  At crowded places the windows of a stretch go
   out one by one, each by its own hash.
2. Per gram, equal stretches have an earliest one; the others repeat it whole.  Grams
   with stretches that differ are asked for: only there can a window be shared by
   stretches that are not equal.
3. Those stretches are cut from the texts and indexed, bucket by bucket: a run-length
   Burrows-Wheeler transform is streamed backwards by all stretches at once, and a
   window is marked if its interval has an earlier member.
4. Where many stretches share a gram, as at the ends of a passage that many
   documents have, no index is to hold them.  Their windows are hashed one by one and
   go out by hash, only the earliest of each task.
5. The marks meet their text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageledger.llm import textops
from usageledger.llm.run_index import first_occurrences
from usageledger.llm.shipping import map_arrow, ship
from usageledger.session import materialize

WINDOW = 100
GRAM = 32
GRAMS = WINDOW - GRAM + 1
PIECE_BYTES = 1 << 20
GATHER_BYTES = 16 << 20
BUCKET_BYTES = 2 << 20
INDEX_BYTES = 1 << 19
CROWD = 256
CROWDED = 1 << 16
LOCAL = 8
PLACE_BITS = 24
BLOCK_BITS = 15
GATHER_WINDOWS = 1 << 19
BUCKET_WINDOWS = 1 << 17

_MARK = "doc_id long, start int, size int"
_FIELDS = (("gram", 8), ("whole", 8), ("doc", 8), ("start", 4), ("left", 1), ("size", 1))


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on (of fewer at the end)."""
    h = textops.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[buf]
    width, factor = 1, 0x2545F4914F6CDD1D
    while width < GRAM:
        if len(h) > width:
            h[:-width] = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    return textops.mix(h)


def stretches(buf: np.ndarray, off: np.ndarray, grams: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Gram hash, row, first window, place of the gram after it, and number of windows
    of every stretch of the rows, in text order.  ``grams`` are the hashes of all grams, if
    they are known."""
    size = np.diff(off)
    n = len(buf)
    row_of = np.repeat(np.arange(len(size)), size)
    starts = np.flatnonzero(np.arange(n) + WINDOW <= off[1:][row_of]) if n else np.empty(0, np.int64)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    grams = _gram_hashes(buf) if grams is None else grams
    blocks = -(-(n + GRAMS) // GRAMS)
    keys = np.full(blocks * GRAMS, np.iinfo(np.uint64).max, np.uint64)
    keys[:n] = grams
    keys = ((keys >> np.uint64(7)) << np.uint64(7)).reshape(blocks, GRAMS) | np.arange(GRAMS, dtype=np.uint64)
    ahead = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()[starts]
    behind = np.minimum.accumulate(keys, axis=1).ravel()[starts + GRAMS - 1]
    later = (behind >> np.uint64(7)) < (ahead >> np.uint64(7))
    block = np.where(later, (starts + GRAMS - 1) // GRAMS, starts // GRAMS)
    least = block * GRAMS + (np.where(later, behind, ahead) & np.uint64(127)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1])])
    first, gram = starts[new], least[new]
    count = np.diff(np.r_[new, len(starts)])
    return grams[gram], row_of[first], first, gram - first, count


def _pack(columns: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    """The chosen rows as byte planes, which compress well."""
    return b"".join(
        np.ascontiguousarray(columns[name][at].astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes()
        for name, width in _FIELDS
    )


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    total = sum(width for _, width in _FIELDS)
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in _FIELDS}
    for blob in blobs:
        rows, at = len(blob) // total, 0
        for name, width in _FIELDS:
            plane = np.frombuffer(blob, np.uint8, rows * width, at).reshape(width, rows)
            parts[name].append(np.ascontiguousarray(plane.T).view(f"<u{width}").ravel())
            at += rows * width
    out = {name: np.concatenate(part or [np.empty(0, f"<u{w}")]) for (name, part), (_, w) in zip(parts.items(), _FIELDS)}
    return {name: v if name in ("gram", "whole") else v.astype(np.int64) for name, v in out.items()}


def _later_copies(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by stretch and place; whether an equal stretch stands earlier."""
    order = np.lexsort((columns["start"], columns["doc"], columns["whole"], columns["gram"]))
    c = {name: columns[name][order] for name in ("gram", "whole", "doc", "start")}
    head = np.ones(len(order), bool)
    head[1:] = (c["gram"][1:] != c["gram"][:-1]) | (c["whole"][1:] != c["whole"][:-1])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    return order, (c["doc"] != c["doc"][first]) | (c["start"] != c["start"][first])


def _merged(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Marked stretches, with overlapping ones of a document joined."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]
    if len(doc):
        number = np.cumsum(np.r_[True, doc[1:] != doc[:-1]]) - 1
        base = number * (int(end.max()) + 1)
        reach = np.maximum.accumulate(base + end)
        at = np.flatnonzero(np.r_[True, base[1:] + start[1:] > reach[:-1]])
        last = np.r_[at[1:] - 1, len(doc) - 1]
        doc, start, end = doc[at], start[at], (reach - base)[last]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32))],
        names=["doc_id", "start", "size"],
    )


def _dealt(gathered: list[dict[str, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, blob) of the earliest of equal stretches, and marks of the others,
    which any bucket may carry on."""
    columns = {name: np.concatenate([g[name] for g in gathered]) for name, _ in _FIELDS}
    order, later = _later_copies(columns)
    gone = order[later]
    marks = _merged(columns["doc"][gone], columns["start"][gone], columns["size"][gone] + WINDOW - 1)
    carrier = pa.array((marks.column("doc_id").to_numpy() % buckets).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [carrier, pa.nulls(marks.num_rows, pa.binary()), *marks.columns],
        names=["bucket", "blob", "doc_id", "start", "size"],
    )
    rest = order[~later]
    bucket = (columns["gram"][rest] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    present, cuts = np.unique(bucket[by], return_index=True)
    blobs = [_pack(columns, rest[part]) for part in np.split(by, cuts[1:])] if len(by) else []
    none = pa.nulls(len(blobs), pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array(present.astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.int64()), none, none],
        names=["bucket", "blob", "doc_id", "start", "size"],
    )


def _frequent(least: int):
    """Step 0 for one task: rows (place, n) of the grams that ``least`` or more different
    stretches of ``GATHER_BYTES`` of text share."""

    def counted(gathered: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, whole = (np.concatenate(parts) for parts in zip(*gathered))
        order = np.lexsort((whole, gram))
        gram, whole = gram[order], whole[order]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        kinds = new.copy()
        kinds[1:] |= whole[1:] != whole[:-1]
        n = np.bincount(np.cumsum(new) - 1, kinds).astype(np.int64)
        place = (gram[new] >> np.uint64(64 - PLACE_BITS)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(place[n >= least]), pa.array(n[n >= least])], names=["place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            for _, _, buf, off in textops.pieces(batch.column("text"), PIECE_BYTES):
                grams = _gram_hashes(buf)
                gram, _, start, _, count = stretches(buf, off, grams)
                last = start + count + WINDOW - 1 - GRAM
                whole = count.astype(np.uint64)
                for at in range(0, 2 * GRAMS + GRAM, GRAM):  # grams side by side cover a stretch
                    whole = textops.mix(whole ^ grams[np.minimum(start + at, last)])
                gathered.append((gram, whole))
                held += len(buf)
                if held >= GATHER_BYTES:
                    yield counted(gathered)
                    gathered, held = [], 0
        if gathered:
            yield counted(gathered)

    return run


def crowded_places(texts: DataFrame) -> dict[int, bytes]:
    """Bits of the places that more than ``CROWDED`` different stretches share, in blocks
    of 4 KB: 512 of them at most, whatever the size of the corpus.

    A gram with fewer than ``LOCAL`` stretches in all that a task counts at once is not
    seen; so ``LOCAL`` stretches for each ``GATHER_BYTES`` of text can still meet in a task.
    A place may have several grams.  How a gram is dealt with follows from its place alone,
    so equal windows always meet and the result does not depend on the counts.
    """
    counts = texts.transform(map_arrow, _frequent(LOCAL), "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    block, bit = F.shiftright("place", BLOCK_BITS), F.col("place").bitwiseAND((1 << BLOCK_BITS) - 1)
    rows = counts.where(F.col("n") > CROWDED).groupBy(block.alias("block")).agg(F.bitmap_construct_agg(bit.cast("long")).alias("bits"))
    return {row["block"]: bytes(row["bits"]) for row in rows.collect()}


def _is_crowded(gram: np.ndarray, blocks: dict[int, bytes]) -> np.ndarray:
    place = (gram >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
    out = np.zeros(len(gram), bool)
    for block, bits in blocks.items():
        own = np.flatnonzero(place >> BLOCK_BITS == block)
        out[own] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[place[own] & ((1 << BLOCK_BITS) - 1)]
    return out


def _scan(buckets: int, blocks: dict[int, bytes]):
    """Step 1.  Rows (bucket, blob) and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, end, buf, off in textops.pieces(batch.column("text"), PIECE_BYTES):
                gram, row, start, left, count = stretches(buf, off)
                crowd = _is_crowded(gram, blocks)
                if crowd.any():
                    own = {"start": start - off[row], "size": count + WINDOW - 1, "left": left, "gram": gram.view(np.int64)}
                    own = {name: values[crowd] for name, values in own.items()}
                    gathered.append(_windows(buf, off, ids[first:end], row[crowd], own))
                    held += GRAM * len(gathered[-1]["gram"])
                    gram, row, start, left, count = (values[~crowd] for values in (gram, row, start, left, count))
                whole = textops.span_hashes(buf, start, start + count + WINDOW - 1) ^ left.astype(np.uint64)
                gathered.append(
                    {
                        "gram": gram,
                        "whole": whole,
                        "doc": ids[first:end][row],
                        "start": start - off[row],
                        "left": left,
                        "size": count,
                    }
                )
                held += len(buf)
                if held >= GATHER_BYTES:
                    yield from _dealt(gathered, buckets)
                    gathered, held = [], 0
        if gathered:
            yield from _dealt(gathered, buckets)

    return run


def _settle(table: pa.Table) -> pa.Table:
    """Step 2 for one bucket: marks (gram null), those of step 1 with them, and
    requests (gram set).  ``crowd`` says whether very many stretches share the gram."""
    packed = pc.is_valid(table.column("blob"))
    ready = table.filter(pc.invert(packed)).select(["doc_id", "start", "size"])
    c = _unpack([blob.as_py() for blob in table.filter(packed).column("blob")])
    order, later = _later_copies(c)
    gone, kept = order[later], order[~later]
    gram = c["gram"][kept]
    whole = c["whole"][kept]
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    kinds = new.copy()
    kinds[1:] |= whole[1:] != whole[:-1]
    group = np.cumsum(new) - 1
    many = np.bincount(group, kinds)[group]
    asked = many > 1
    kept, many = kept[asked], many[asked]
    both = np.r_[gone, kept]
    unset, none = np.zeros(len(gone), bool), np.ones(len(kept), bool)
    found = pa.table(
        {
            "doc_id": pa.array(c["doc"][both]),
            "start": pa.array(c["start"][both].astype(np.int32)),
            "size": pa.array((c["size"][both] + WINDOW - 1).astype(np.int32)),
            "left": pa.array(c["left"][both].astype(np.int32)),
            "gram": pa.array(c["gram"][both].view(np.int64), mask=~np.r_[unset, none]),
            "crowd": pa.array(np.r_[unset, many > CROWD]),
        }
    )
    for name, kind, value in (("left", pa.int32(), None), ("gram", pa.int64(), None), ("crowd", pa.bool_(), False)):
        ready = ready.append_column(name, pa.array([value] * len(ready), kind))
    return pa.concat_tables([found, ready])


def _windows(buf: np.ndarray, off: np.ndarray, ids: np.ndarray, row: np.ndarray, asked: dict) -> dict[str, np.ndarray]:
    """The windows of the stretches asked for, as stretches of one window each.  Equal
    windows stand at one distance from one gram, so the gram counts as part of the hash."""
    inside = asked["start"] + asked["size"] <= np.diff(off)[row]
    asked, row = {name: values[inside] for name, values in asked.items()}, row[inside]
    count = asked["size"] - WINDOW + 1
    shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(off[row] + asked["start"], count) + shift
    by = np.argsort(at, kind="stable")
    at, row = at[by], np.repeat(row, count)[by]
    left = np.repeat(asked["left"], count)[by] - shift[by]
    whole = textops.span_hashes(buf, at, at + WINDOW) ^ left.astype(np.uint64)
    gram = np.repeat(asked["gram"], count)[by].view(np.uint64)
    one = np.ones(len(at), np.int64)
    return {
        "gram": textops.mix(gram ^ whole), "whole": whole, "doc": ids[row], "start": at - off[row], "left": left, "size": one
    }


_CUT = "bucket int, blob binary, doc_id long, start int, size int, bytes binary"


def _cut(index_buckets: int, window_buckets: int):
    """Steps 3 and 4: the bytes of the stretches asked for, by gram, and the windows of
    those in a crowd, by hash, in buckets after the others."""

    def crowded(gathered: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for batch in _dealt(gathered, window_buckets):
            bucket = pc.add(batch.column("bucket"), pa.scalar(index_buckets, pa.int32()))
            yield batch.set_column(0, "bucket", bucket).append_column("bytes", pa.nulls(batch.num_rows, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, end, buf, off in textops.pieces(batch.column("text"), PIECE_BYTES):
                lists = batch.column("asked").slice(first, end - first)
                row = np.repeat(np.arange(end - first), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                asked = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("start", "size", "left", "gram")}
                asked = {name: values.astype(np.int64) for name, values in asked.items()}
                crowd = flat.field("crowd").to_numpy(zero_copy_only=False).astype(bool)
                if crowd.any():
                    own = {name: values[crowd] for name, values in asked.items()}
                    gathered.append(_windows(buf, off, ids[first:end], row[crowd], own))
                    held += len(gathered[-1]["gram"])
                    if held >= GATHER_WINDOWS:
                        yield from crowded(gathered)
                        gathered, held = [], 0
                at = off[row] + asked["start"]
                stop = np.minimum(at + asked["size"], off[row + 1])
                few = np.flatnonzero(~crowd)
                bucket = asked["gram"][few].view(np.uint64) % np.uint64(index_buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket.astype(np.int32)),
                        pa.nulls(len(few), pa.binary()),
                        pa.array(ids[first:end][row[few]]),
                        pa.array(asked["start"][few].astype(np.int32)),
                        pa.nulls(len(few), pa.int32()),
                        pa.array([buf[at[i] : stop[i]].tobytes() for i in few], pa.binary()),
                    ],
                    names=[part.split()[0] for part in _CUT.split(", ")],
                )
        if gathered:
            yield from crowded(gathered)

    return run


def _index(table: pa.Table) -> pa.Table:
    """Steps 3 and 4 for one bucket: marks of the windows with an earlier equal one."""
    blobs, pieces = pc.is_valid(table.column("blob")), pc.is_valid(table.column("bytes"))
    ready = table.filter(pc.invert(pc.or_(blobs, pieces))).select(["doc_id", "start", "size"])
    c = _unpack([blob.as_py() for blob in table.filter(blobs).column("blob")])
    order, later = _later_copies(c)
    gone = order[later]
    table = table.filter(pieces).sort_by([("doc_id", "ascending"), ("start", "ascending")])
    doc, start = c["doc"][gone], c["start"][gone]
    if len(table):
        number, offset, again = first_occurrences(table.column("bytes").to_pylist(), WINDOW)
        number, offset = number[again], offset[again]
        doc = np.r_[doc, table.column("doc_id").to_numpy()[number]]
        start = np.r_[start, table.column("start").to_numpy()[number].astype(np.int64) + offset]
    found = pa.Table.from_batches([_merged(doc, start, np.full(len(doc), WINDOW))])
    return pa.concat_tables([ready.cast(found.schema), found])


def _spans(marks: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, length in sorted(marks):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + length))
        else:
            out.append((start, start + length))
    return out


def find_repeats(documents: DataFrame) -> DataFrame:
    """doc_id and ``marks``, the list of (start, size) to remove, for the documents
    that have any.  Marks may overlap."""
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-volume // BUCKET_BYTES))
    settled = materialize(
        texts.transform(map_arrow, _scan(buckets, crowded_places(texts)), f"bucket int, blob binary, {_MARK}")
        .groupBy("bucket")
        .applyInArrow(_settle, f"{_MARK}, left int, gram long, crowd boolean"),
        "settled",
    )
    requests = settled.where("gram IS NOT NULL")
    wanted, crowded = requests.agg(
        F.sum(F.when(~F.col("crowd"), F.col("size"))), F.sum(F.when(F.col("crowd"), F.col("size") - (WINDOW - 1)))
    ).first()
    asked = requests.groupBy("doc_id").agg(
        F.collect_set(F.struct("start", "size", "left", "gram", "crowd")).alias("asked")
    )
    index_buckets = max(1, -(-(wanted or 0) // INDEX_BYTES))
    window_buckets = max(1, -(-(crowded or 0) // BUCKET_WINDOWS))
    cut = texts.dropDuplicates(["doc_id"]).join(asked, "doc_id").transform(map_arrow, _cut(index_buckets, window_buckets), _CUT)
    indexed = cut.groupBy("bucket").applyInArrow(_index, _MARK)
    columns = ["doc_id", "start", "size"]
    marks = settled.where("gram IS NULL").select(columns).union(indexed)
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("marks"))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed and n_spans for every row.

    A null text counts as empty.  Rows of one doc_id are taken to repeat one text and
    are not earlier than each other; rows with a null doc_id keep their text and do
    not count as a source.  Texts under 100 bytes lose nothing.
    """
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    marked = texts.join(find_repeats(documents), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                kept, counts = [], []
                for text, marks in zip(part.column("text"), part.column("marks")):
                    data = (text.as_py() or "").encode()
                    spans = _spans([(m["start"], m["size"]) for m in marks.as_py() or []])
                    edges = [0, *(x for span in spans for x in span), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    counts.append((len(data), len(data) - len(kept[-1]), len(spans)))
                columns = [pa.array(column, pa.int64()) for column in zip(*counts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.binary()), *columns],
                    names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
                )

    return marked.transform(
        map_arrow, run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"
    )


def cut_text(marked: DataFrame) -> DataFrame:
    """``marked`` (with the columns text and marks) without the marked bytes, and
    without the rest of a character that a cut has split; null texts stay null."""
    place = marked.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = []
                for text, marks in zip(part.column("text"), part.column("marks")):
                    value = text.as_py()
                    if value is not None and marks.is_valid:
                        data = value.encode()
                        edges = [0, *(x for s in _spans([(m["start"], m["size"]) for m in marks.as_py()]) for x in s)]
                        rest = b"".join(data[a:b] for a, b in zip(edges[::2], [*edges[1::2], len(data)]))
                        value = rest.decode(errors="ignore")
                    texts.append(value)
                yield part.set_column(place, "text", pa.array(texts, part.column("text").type))

    return marked.transform(map_arrow, run, marked.schema)


def digests(removed: DataFrame) -> DataFrame:
    """The counts and the digest of what remains."""
    return removed.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
