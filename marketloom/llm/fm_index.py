"""An FM-index over integer symbols in numpy: suffix array, wavelet matrix, sampled positions.

The indexed text is a set of runs.  Each run ends with a separator of its own that sorts below all
symbols, so comparing suffixes ends at the run's end and positions are never walked across runs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; ``rank`` holds the first symbols' order (separators distinct)."""
    n = len(rank)
    step = 1
    rank = np.unique(rank, return_inverse=True)[1]  # below n, however large and sparse the symbols are
    while True:
        first = np.empty(n, bool)
        first[0] = True
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        first[1:] = ordered[1:] != ordered[:-1]
        place = np.cumsum(first) - 1
        rank = np.empty(n, np.int64)
        rank[order] = place
        if place[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank of any symbol in a sequence, for many (symbol, position) queries at once."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        begin = np.zeros(len(at), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            at = np.where(bit, zeros + ones[at], at - ones[at])
            begin = np.where(bit, zeros + ones[begin], begin - ones[begin])
        return at - begin


class FMIndex:
    """Index of runs of symbols 1..``top``; ``symbols`` holds the runs one after the other, ``lens`` their lengths."""

    def __init__(self, symbols: np.ndarray, lens: np.ndarray, top: int, sample: int = 8):
        runs = len(lens)
        n = len(symbols) + runs
        ends = np.cumsum(lens + 1) - 1
        text = np.zeros(n, np.int64)
        word = np.ones(n, bool)
        word[ends] = False
        text[word] = symbols
        rank = text + runs - 1
        rank[ends] = np.arange(runs)
        order = suffix_array(rank)
        self.bwt = text[order - 1]  # before the first run stands the last separator
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(top).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])  # suffixes below a symbol
        self.n = n
        begins = ends - lens
        self.sampled = (order % sample == 0) | np.isin(order, begins)
        self.place = np.where(self.sampled, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each row of ``patterns`` (equal lengths), by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
        high = np.maximum(high, low)
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk left until a sampled position."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[at])
        while len(open_):
            c = self.bwt[at[open_]]
            at[open_] = self.before[c] + self.wavelet.rank(c, at[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[at[open_]]]
        return self.place[at] + steps
