"""A run-length compressed Burrows-Wheeler index over many short strings."""

from __future__ import annotations

import numpy as np


class RunIndex:
    """Index of byte strings, each closed by an end mark of its own.

    The transform is kept as runs of equal symbols, with the text position sampled
    at the end of each run.  ``depth`` names a match length: ranks whose suffixes
    agree in that many bytes form an interval.
    """

    def __init__(self, strings: list[bytes], depth: int) -> None:
        self.depth = depth
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begins = np.cumsum(self.lengths + 1) - self.lengths - 1
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        marks = self.begins + self.lengths
        text[marks] = 0
        order, same = self._sorted(text, marks)
        before = np.where(np.isin(order, self.begins), 0, text[order - 1])
        # Where a string begins, the run is one rank long: nothing stands to its left.
        self.run_start = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (before[1:] == 0)])
        self.run_end = np.r_[self.run_start[1:], len(before)]
        symbol, size = before[self.run_start], self.run_end - self.run_start
        self.run_symbol = symbol
        self.sample = order[self.run_end - 1]
        by_symbol = np.argsort(symbol, kind="stable")
        self.run_target = np.empty(len(symbol), np.int64)
        self.run_target[by_symbol] = np.cumsum(size[by_symbol]) - size[by_symbol]
        self.interval_start = np.flatnonzero(~same)

    def _sorted(self, text: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by prefix doubling, and whether a suffix agrees with the one
        before it in ``depth`` symbols.  Equal strings are ordered by their number."""
        n, many = len(text), len(marks)
        owner = np.repeat(np.arange(many), self.lengths + 1)
        left = marks[owner] - np.arange(n)
        key = np.zeros(n, np.int64)
        for k in range(7):
            at = np.minimum(np.arange(n) + k, n - 1)
            key = key * 512 + np.where(left >= k, text[at], 0)
        rank, covered = self._ranks(key), 7
        half, class_of = None, None
        while True:
            if half is None and 2 * covered >= self.depth:
                half = rank.copy()
                shift = self.depth - covered
                at = np.minimum(np.arange(n) + shift, n - 1)
                class_of = np.where(left >= self.depth, half * (n + 1) + half[at], -1 - np.arange(n))
            if rank.max() == n - 1 and half is not None:
                break
            at = np.minimum(np.arange(n) + covered, n - 1)
            tail = np.where(left >= covered, rank[at] + many, owner)
            rank, covered = self._ranks(rank * (n + many) + tail), 2 * covered
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        ranked = class_of[order]
        return order, np.r_[False, ranked[1:] == ranked[:-1]]

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ranked = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
        return out

    def step(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the suffix one symbol longer to the left, and that symbol."""
        run = np.searchsorted(self.run_start, rank, "right") - 1
        return self.run_target[run] + rank - self.run_start[run], self.run_symbol[run]

    def locate(self, rank: int) -> int:
        """Text position of a rank: step left until a sampled run end is met."""
        steps = 0
        run = int(np.searchsorted(self.run_start, rank, "right")) - 1
        while rank != self.run_end[run] - 1:
            rank, steps = int(self.run_target[run] + rank - self.run_start[run]), steps + 1
            run = int(np.searchsorted(self.run_start, rank, "right")) - 1
        return int(self.sample[run]) + steps

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Read all strings backwards, in step, through the index.

        For each position with ``depth`` bytes to its right: string number, offset
        and the interval of its match; the matching statistic reaches ``depth``
        wherever an interval holds more than one position.
        """
        number = np.arange(len(self.lengths))
        rank = number.copy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for done in range(1, int(self.lengths.max(initial=0)) + 1):
            live = self.lengths[number] >= done
            number, rank = number[live], rank[live]
            rank, _ = self.step(rank)
            if done >= self.depth:
                interval = np.searchsorted(self.interval_start, rank, "right") - 1
                found.append((number, self.lengths[number] - done, interval))
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(part) for part in zip(*found))


def first_occurrences(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String number and offset of every window of ``depth`` bytes, and whether an
    equal window stands earlier (in a string before, or before in the same string)."""
    index = RunIndex(strings, depth)
    number, offset, interval = index.stream()
    place = number * (int(index.lengths.max(initial=0)) + 1) + offset
    first = np.full(len(index.interval_start), np.iinfo(np.int64).max)
    np.minimum.at(first, interval, place)
    return number, offset, place > first[interval]
