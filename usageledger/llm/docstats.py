"""Statistics of each text, for the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from usageledger.llm import textops

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.zeros(256, bool)
_HIGH[192:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?!")] = True


class Stats:
    """Words, lines and repetitions of the rows of one piece."""

    def __init__(self, buf: np.ndarray, off: np.ndarray) -> None:
        self.buf, self.off = buf, off
        starts, ends = textops.word_spans(buf, off)
        self.owner, self.n_words = textops.owners(starts, off)
        self.hashes = textops.span_hashes(buf, starts, ends)
        self.word_chars = textops.sums(~textops.SPACE[buf] & ((buf & 0xC0) != 0x80), off)
        self.n_symbols = textops.sums(_SYMBOL[buf], off)
        self._lines(starts)
        self._repeats()

    def _lines(self, words: np.ndarray) -> None:
        breaks = np.flatnonzero(self.buf == 10)
        begins = np.union1d(self.off[:-1], breaks + 1)
        begins = begins[begins < len(self.buf)]
        stops = np.r_[begins[1:], len(self.buf)][: len(begins)]
        stops = stops - (self.buf[stops - 1] == 10) if len(stops) else stops
        full = np.diff(np.searchsorted(words, np.r_[begins, len(self.buf)])) > 0
        begins, stops = begins[full], stops[full]
        owner, self.n_lines = textops.owners(begins, self.off)
        keys = textops.with_owner(textops.span_hashes(self.buf, begins, stops), owner)
        _, first = np.unique(keys, return_index=True)
        distinct = np.bincount(owner[first], minlength=len(self.n_lines))
        self.n_dup_lines = self.n_lines - distinct

    def _repeats(self) -> None:
        keys, at = textops.shingles(self.hashes, self.owner, 3)
        again = at[textops.repeated(textops.with_owner(keys, self.owner[at]))]
        covered = np.zeros(len(self.hashes), bool)
        for k in range(3):
            covered[again + k] = True
        self.n_repeat_words = np.bincount(self.owner[covered], minlength=len(self.n_words))

    def features(self) -> np.ndarray:
        """Transformed statistics, one row per text; all finite, also for no text."""
        chars = textops.sums((self.buf & 0xC0) != 0x80, self.off)
        keys = textops.with_owner(self.hashes, self.owner)
        _, first = np.unique(keys, return_index=True)
        distinct = np.bincount(self.owner[first], minlength=len(self.n_words))

        def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
            return np.log((part + 0.05) / (whole + 10.0))

        letters = [textops.sums(table[self.buf], self.off) for table in (_UPPER, _LOWER, _DIGIT, _HIGH, _STOP)]
        return np.column_stack(
            [
                np.log1p(self.n_words),
                np.log((self.word_chars + 5.0) / (self.n_words + 1.0)),
                share(self.n_symbols, chars),
                share(self.n_dup_lines, self.n_lines),
                share(self.n_repeat_words, self.n_words),
                share(distinct, self.n_words),
                np.log((self.n_lines + 1.0) / (self.n_words + 10.0)),
                *(share(count, chars) for count in letters),
            ]
        )
