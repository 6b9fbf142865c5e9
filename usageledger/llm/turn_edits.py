"""Cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Every row is a symbol: the initial of its role and its fault.  Equal neighbours are one
run; the cost of a run of any length follows from cached powers (1, 2, 4, ... rows) of
the symbol's min-plus transition between four states.  Costs go from the last run to the
first; the edits are then unrolled from the first to the last, the least letter first
among the cheapest, again by powers.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

Vector = tuple[int, int, int, int]

#: States: nothing yet, after the system row, after a user row, after an assistant row.
STATES = range(4)
ENDLESS = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The state after a user or assistant row that is put in or given another role.
PUT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: The state after keeping a row, by the initial of its role.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}

#: Cost from each state after the last row: rows put in until the roles are complete.
END: Vector = (0, 2 * INSERT, INSERT, 0)

#: The symbol of rows that have to go, whatever their role.
GONE = "-"
_CACHED_POWER = 10


def symbol(role: str, fault: str) -> str:
    """``fault`` is empty, blank, duplicate or truncated.  Truncated rows are capitals."""
    if fault in ("blank", "duplicate"):
        return GONE
    initial = role[:1] if role[:1] in KEPT else "o"
    return initial.upper() if fault == "truncated" else initial


def _edits(sign: str) -> list[tuple[str, int, tuple[int | None, ...]]]:
    """Letter, cost and following states of the edits of one row."""
    out: list[tuple[str, int, tuple[int | None, ...]]] = [("D", DELETE, tuple(STATES))]
    if sign != GONE:
        extra = TRUNCATED if sign.isupper() else 0
        if sign.lower() in KEPT:
            out.append(("K", KEEP + extra, KEPT[sign.lower()]))
        out.append(("R", REROLE + extra, PUT))
    return out


@lru_cache(maxsize=None)
def power(sign: str, k: int) -> tuple[Vector, ...]:
    """Min-plus matrix of ``2 ** k`` rows of one symbol, with rows put in before each."""
    if k:
        half = power(sign, k - 1)
        columns = [advance_by(half, tuple(half[s][t] for s in STATES)) for t in STATES]
        return tuple(tuple(columns[t][s] for t in STATES) for s in STATES)
    rows = []
    for start in STATES:
        best = [ENDLESS] * 4
        at, cost = start, 0
        for _ in range(3):
            for _, price, following in _edits(sign):
                if following[at] is not None:
                    best[following[at]] = min(best[following[at]], cost + price)
            at, cost = PUT[at], cost + INSERT
        rows.append(tuple(best))
    return tuple(rows)


def advance_by(matrix: tuple[Vector, ...], after: Vector) -> Vector:
    """Costs before a stretch from the costs after it."""
    return tuple(min(ENDLESS, *(row[t] + after[t] for t in STATES)) for row in matrix)


def multiply(left: tuple[Vector, ...], right: tuple[Vector, ...]) -> tuple[Vector, ...]:
    columns = [advance_by(left, tuple(right[s][t] for s in STATES)) for t in STATES]
    return tuple(tuple(columns[t][s] for t in STATES) for s in STATES)


IDENTITY = tuple(tuple(0 if s == t else ENDLESS for t in STATES) for s in STATES)


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(sign, sum(1 for _ in same)) for sign, same in groupby(symbols)]


def _powers(length: int) -> list[int]:
    return [k for k in range(length.bit_length()) if length >> k & 1]


def matrix(symbols: str) -> tuple[Vector, ...]:
    """The transition of a stretch of rows."""
    out = IDENTITY
    for sign, length in runs(symbols):
        for k in _powers(length):
            out = multiply(out, power(sign, k))
    return out


def _step(sign: str, state: int, after: Vector) -> tuple[str, int]:
    """Letters of one row, and of rows put in before it, from a state."""
    before = advance_by(power(sign, 0), after)
    letters = ""
    while True:
        for letter, price, following in [("D", DELETE, tuple(STATES)), ("I", INSERT, PUT), *_edits(sign)[1:]]:
            to = following[state]
            if to is not None and price + (before if letter == "I" else after)[to] == before[state]:
                letters, state = letters + letter, to
                break
        if letter != "I":
            return letters, state


def _unroll(sign: str, k: int, state: int, after: Vector) -> tuple[str, int]:
    """Letters of ``2 ** k`` rows of one symbol.  Only differences of costs matter."""
    least = min(after)
    plain = tuple(min(ENDLESS, cost - least) if cost < ENDLESS else ENDLESS for cost in after)
    return (_cached if k <= _CACHED_POWER else _halves)(sign, k, state, plain)


def _halves(sign: str, k: int, state: int, after: Vector) -> tuple[str, int]:
    if not k:
        return _step(sign, state, after)
    first, state = _unroll(sign, k - 1, state, advance_by(power(sign, k - 1), after))
    second, state = _unroll(sign, k - 1, state, after)
    return first + second, state


_cached = lru_cache(maxsize=1 << 14)(_halves)


def unroll(symbols: str, state: int, after: Vector) -> tuple[str, int]:
    """The letters of a stretch from a state, and the state after it."""
    blocks = [(sign, k) for sign, length in runs(symbols) for k in _powers(length)]
    costs = [after]
    for sign, k in reversed(blocks):
        costs.append(advance_by(power(sign, k), costs[-1]))
    out = []
    for (sign, k), cost in zip(blocks, reversed(costs[:-1])):
        letters, state = _unroll(sign, k, state, cost)
        out.append(letters)
    return "".join(out), state


def closing(state: int) -> str:
    """Letters of the rows put in after the last row."""
    return "I" * (END[state] // INSERT)


def repair(symbols: str) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a whole conversation."""
    letters, state = unroll(symbols, 0, END)
    return advance_by(matrix(symbols), END)[0], letters + closing(state)
