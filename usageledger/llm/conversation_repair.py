"""Repair of conversations: faults of rows, and the cheapest edits that mend the roles.

Rows are dealt out by ranges of (conversation, turn, ...) and sorted, so a conversation
of any length lies in a stretch of neighbouring tasks.  A conversation that begins and
ends inside one task is repaired there.  What may cross an edge, or is longer than a
bound, is written to the scratch folder as stretches, one for each task and conversation:
each stretch gives its min-plus matrix; the few matrices of a conversation give the costs
after each stretch; with these a stretch is unrolled from all four states; the states
then say which of the four holds.  Only the digest of a conversation, which is one
sequence, passes its rows in order through one task, a batch at a time.

Rows of the same turn (nulls first) go by role, first characters of the text, and a hash
of the text.  Null roles and texts count as one space.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.llm import turn_edits
from usageledger.llm.shipping import map_arrow
from usageledger.session import materialize

#: Rows and bytes of text of one conversation that a task holds at once.
HELD_ROWS = 4096
HELD_BYTES = 16 << 20
_SPACE = r" \t\n\u000B\u000C\r"
_PREFIX = 256
_LEGAL = ("su", "ua", "au")

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = ", ".join(f"{name} long" for name in _COUNTS) + ", audit string, repaired_sha256 string"
_ROW = "part int, place long, turn long, role string, text string, dropped boolean, empty boolean, cut boolean"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32(``conv_id:turn``) modulo 20, a null as one space:
    0 drops a row (it stays, marked as dropped, so that its conversation is known), 1
    empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 sets the role user."""
    name = lambda column: F.coalesce(F.col(column).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    return (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.when(fate == 4, "user").otherwise(name("role")).alias("role"),
            text.alias("text"),
            (fate == 0).alias("dropped"),
            F.when(fate == 3, 2).otherwise(1).alias("copies"),
        )
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        .drop("copies", "copy")
    )


def _judged(rows: DataFrame) -> DataFrame:
    """``empty``: the text has no visible character; ``cut``: the last one is not ``.!?``."""
    shown = F.expr(f"rtrim('{_SPACE}', text)")
    return rows.withColumns({"empty": shown == "", "cut": ~F.right(shown, F.lit(1)).isin(".", "!", "?")})


def _ordered(rows: DataFrame) -> DataFrame:
    """Sorted ranges of rows; equal rows may lie in several ranges."""
    keys = ["conv_id", "turn", "role", F.substring("text", 1, _PREFIX), F.xxhash64("text")]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranges = spread.repartitionByRange(*keys, "_tie")
    return ranges.sortWithinPartitions(*keys, "_tie").drop("_tie")


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode(errors="surrogatepass")


class _Writer:
    """The digest of repaired rows; edits are letters that rows use up one by one."""

    def __init__(self) -> None:
        self.digest, self.started = hashlib.sha256(), False

    def write(self, line: bytes) -> None:
        self.digest.update((b"\n" if self.started else b"") + line)
        self.started = True

    def inserted(self, state: int) -> int:
        self.write(_line(turn_edits.ROLE[state], ""))
        return turn_edits.PUT[state]

    def row(self, letter: str, state: int, role: str, text: str) -> int:
        if letter == "D":
            return state
        if letter == "R":
            self.write(_line(turn_edits.ROLE[state], text))
            return turn_edits.PUT[state]
        self.write(_line(role, text))
        return turn_edits.KEPT[role[:1]][state]

    def rows(self, letters: Iterator[str], state: int, rows: Iterator[tuple[str, str]]) -> int:
        for role, text in rows:
            letter = next(letters)
            while letter == "I":
                state = self.inserted(state)
                letter = next(letters)
            state = self.row(letter, state, role, text)
        return state


def _report(rows: list[dict]) -> tuple:
    """The columns of REPORT for all rows of a conversation."""
    rows = [row for row in rows if not row["dropped"]]
    faults, seen = [], set()
    for row in rows:
        key = (row["role"], row["text"])
        faults.append(
            "blank" if row["empty"] else "duplicate" if key in seen else "truncated" if row["cut"] else ""
        )
        seen.add(key)
    count = Counter(faults)
    turns = {row["turn"] for row in rows if row["turn"] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [row["role"][:1] for row in rows]
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
    cost, audit = turn_edits.repair("".join(turn_edits.symbol(r["role"], f) for r, f in zip(rows, faults)))
    writer, letters = _Writer(), iter(audit)
    state = writer.rows(letters, 0, ((row["role"], row["text"]) for row in rows))
    for _ in letters:
        state = writer.inserted(state)
    return (
        gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, writer.digest.hexdigest()
    )


def _first_pass(held_rows: int, held_bytes: int):
    """Whole conversations give their report, other rows stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        nothing = (None,) * len(REPORT.split(", "))
        # A row's place counts all rows of the task, so part and place name one row.
        first, key, held, size, place, passing = True, None, [], 0, 0, True

        def raw(rows: list[dict]) -> list[tuple]:
            return [
                (row["conv_id"], *nothing, part, row["place"], *(row[n] for n in ("turn", "role", "text", "dropped", "empty", "cut")))
                for row in rows
            ]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND
            )

        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if first or row["conv_id"] != key:
                    if not first and not passing:
                        out.append((key, *_report(held), *(None,) * 8))
                        held = []
                    elif held:
                        out += raw(held)
                    # The first conversation of a task may have begun in the one before.
                    passing, first = first, False
                    key, held, size = row["conv_id"], [], 0
                held.append(row | {"place": place})
                place += 1
                size += len(row["text"])
                passing = passing or len(held) > held_rows or size > held_bytes
                if passing and (len(held) > held_rows or size > held_bytes):
                    out += raw(held)
                    held, size = [], 0
            if out:
                yield table(out)
        if held:
            yield table(raw(held))

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_KINDS |= {f"array<{name}>": pa.list_(kind) for name, kind in _KINDS.items()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (field.split() for field in schema.split(", "))])


_FOUND_DDL = f"conv_id long, {REPORT}, {_ROW}"
_FOUND = _arrow(_FOUND_DDL)


def _numbers(vector) -> list[int]:
    return [number for row in vector for number in row]


def _matrix(numbers: list[int]) -> tuple:
    return tuple(tuple(numbers[k : k + 4]) for k in range(0, 16, 4))


def _map_rows(df: DataFrame, schema: str, function) -> DataFrame:
    """``function`` gives a list of tuples for each row, a dict."""
    made_schema = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = function(row)
                if made:
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(made_schema.names, values)) for values in made], schema=made_schema
                    )

    return map_arrow(df, run, schema)


def _pieces(rows: DataFrame) -> DataFrame:
    """One row for each stretch: conv_id, part, symbols, initials."""
    there = rows.where("NOT dropped")
    first = (
        there.where("NOT empty")
        .groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256))
        .agg(F.min(F.struct("part", "place")).alias("at"))
        .select("at.*", F.lit(True).alias("new"))
    )
    initial = F.substring("role", 1, 1)
    sign = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    judged = there.select("conv_id", "part", "place", initial.alias("initial"), sign.alias("sign"), "empty", "cut").join(
        first, ["part", "place"], "left"
    )
    fault = F.when(F.col("empty"), "b").when(F.col("new").isNull(), "d").when(F.col("cut"), "t").otherwise("")
    return (
        judged.select("conv_id", "part", F.struct("place", "initial", "sign", fault.alias("fault")).alias("row"))
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
    )


def _summarise(row: dict) -> list[tuple]:
    """Matrix, counts and edge initials of a stretch."""
    rows = row["rows"]
    faults = Counter(r["fault"] for r in rows)
    symbols = "".join(
        turn_edits.GONE if r["fault"] in ("b", "d") else r["sign"].upper() if r["fault"] else r["sign"] for r in rows
    )
    initials = [r["initial"] for r in rows]
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
    return [
        (
            row["conv_id"], row["part"], symbols, _numbers(turn_edits.matrix(symbols)),
            initials[0], initials[-1], faults["b"], faults["d"], faults["t"], illegal,
        )
    ]


_SUMMARY = (
    "conv_id long, part int, symbols string, matrix array<long>, first string, last string, "
    "blank long, duplicate long, truncated long, illegal long"
)


def _costs(row: dict) -> list[tuple]:
    """For each stretch of a conversation the costs after it, and whether it is the last
    one; the cost of the whole; illegal pairs across edges."""
    parts = row["parts"]
    after, out = turn_edits.END, []
    for part in reversed(parts):
        out.append((row["conv_id"], part["part"], list(after), part is parts[-1]))
        after = turn_edits.advance_by(_matrix(part["matrix"]), after)
    across = sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(parts, parts[1:]))
    return [(*values, after[0], across) for values in out]


def _unrolled(row: dict) -> list[tuple]:
    """Letters and following state of a stretch from each of the four states."""
    ends = []
    for state in turn_edits.STATES:
        if turn_edits.advance_by(_matrix(row["matrix"]), tuple(row["after"]))[state] >= turn_edits.ENDLESS:
            ends.append(("", 0))
            continue
        letters, to = turn_edits.unroll(row["symbols"], state, tuple(row["after"]))
        ends.append((letters + turn_edits.closing(to) if row["is_last"] else letters, to))
    return [(row["conv_id"], row["part"], [e[0] for e in ends], [e[1] for e in ends])]


def _entries(row: dict) -> list[tuple]:
    """The state in which each stretch of a conversation begins."""
    state, out = 0, []
    for part in row["parts"]:
        out.append((row["conv_id"], part["part"], state))
        state = part["ends"][state]
    return out


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations; before its rows, a stretch has one with the letters."""
    started, key, writer, audit, letters, state = False, None, _Writer(), [], iter(""), 0

    def finish() -> pa.RecordBatch:
        nonlocal state
        for _ in letters:
            state = writer.inserted(state)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key], pa.int64()),
                pa.array(["".join(audit)], pa.string()),
                pa.array([writer.digest.hexdigest()], pa.string()),
            ],
            names=["conv_id", "audit", "repaired_sha256"],
        )

    for batch in batches:
        for row in batch.to_pylist():
            if not started or row["conv_id"] != key:
                if started:
                    yield finish()
                started, key, writer, audit, letters, state = True, row["conv_id"], _Writer(), [], iter(""), 0
            if row["letters"] is not None:
                audit.append(row["letters"])
                letters = iter(row["letters"])
            elif not row["dropped"]:
                state = writer.rows(letters, state, [(row["role"], row["text"])])
    if started:
        yield finish()


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys are equal; the keys of the left side stay."""
    other = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    condition: Column = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, condition, how).drop(*(f"_{k}" for k in keys))


def _across_tasks(rows: DataFrame) -> DataFrame:
    """conv_id and REPORT of the conversations that lie in several stretches."""
    pieces = materialize(_map_rows(_pieces(rows), _SUMMARY, _summarise), "conversation-stretches")
    parts = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "matrix", "first", "last"))).alias("parts")
    )
    costs = materialize(
        _map_rows(parts, "conv_id long, part int, after array<long>, is_last boolean, cost long, across long", _costs),
        "conversation-costs",
    )
    ahead = _same(pieces.select("conv_id", "part", "symbols", "matrix"), costs, ["conv_id", "part"], "inner")
    ends = materialize(
        _map_rows(ahead, "conv_id long, part int, letters array<string>, ends array<int>", _unrolled),
        "conversation-letters",
    )
    states = ends.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "ends"))).alias("parts"))
    begins = _map_rows(states, "conv_id long, part int, state int", _entries)
    letters = _same(ends, begins, ["conv_id", "part"], "inner").select(
        "conv_id", "part", F.lit(-1).cast("long").alias("place"), F.expr("letters[state]").alias("letters")
    )
    ordered = (
        rows.select("conv_id", "part", "place", "role", "text", "dropped")
        .unionByName(letters, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "place")
    )
    written = map_arrow(ordered, _stream, "conv_id long, audit string, repaired_sha256 string")
    turns = (
        rows.where("NOT dropped AND turn IS NOT NULL")
        .groupBy("conv_id", "turn")
        .agg(F.lit(1).alias("n"))
        .groupBy("conv_id")
        .agg((F.max("turn") - F.min("turn") + 1 - F.sum("n")).alias("gaps"))
    )
    counts = pieces.groupBy("conv_id").agg(*(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")))
    whole = costs.groupBy("conv_id").agg(F.first("cost").alias("cost"), F.first("across").alias("across"))
    out = written
    for other in (turns, counts, whole):
        out = _same(out, other, ["conv_id"], "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    return out.withColumn("illegal", zero("illegal") + zero("across")).select(
        "conv_id", *(zero(name).alias(name) for name in _COUNTS), "audit", "repaired_sha256"
    )


def repair(rows: DataFrame, held_rows: int = HELD_ROWS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """conv_id and REPORT for every conversation of ``rows``.

    ``rows`` has conv_id, turn, role, text and dropped; other columns are ignored.  A
    dropped row only makes its conversation known; one without other rows has zeros, no
    edits and the digest of nothing.  Rows without conv_id are one conversation.  Null
    roles and texts count as one space, null turns come first; equal rows are each a
    row.  No rows give no rows.
    """
    space = {name: F.coalesce(F.col(name), F.lit(" ")) for name in ("role", "text")}
    judged = _judged(rows.select("conv_id", "turn", "role", "text", "dropped").withColumns(space))
    found = materialize(
        map_arrow(_ordered(judged), _first_pass(held_rows, held_bytes), _FOUND_DDL), "conversations"
    )
    names = [field.split()[0] for field in REPORT.split(", ")]
    whole = found.where("part IS NULL").select("conv_id", *names)
    crossing = found.where("part IS NOT NULL").select("conv_id", *(f.split()[0] for f in _ROW.split(", ")))
    return whole.unionByName(_across_tasks(crossing))
