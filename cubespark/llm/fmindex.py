"""An FM-index over integer symbols: wavelet-matrix ranks, backward search of many patterns at once, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1 or width >= n:
            return order


class WaveletMatrix:
    """rank and access over symbols 0 .. sigma - 1, in one pass over the bits of a symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        s = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            l1, h1 = self.ones[i][low], self.ones[i][high]
            low = np.where(one, self.zeros[i] + l1, low - l1)
            high = np.where(one, self.zeros[i] + h1, high - h1)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for i in range(self.bits):
            ones = self.ones[i]
            bit = ones[at + 1] - ones[at]
            at = np.where(bit == 1, self.zeros[i] + ones[at], at - ones[at])
            out = out << 1 | bit
        return out


class FMIndex:
    """Index of a text of symbols 1 .. sigma - 1; 0 may stand between its parts."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text, sigma = np.append(text.astype(np.int64) + 1, 0), sigma + 1  # an end of its own keeps the steps back exact
        order = suffix_array(text)
        bwt = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.wavelet = WaveletMatrix(bwt, sigma)
        marked = order % sample == 0
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.samples = order[marked]
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each pattern (a row of an array)."""
        patterns = patterns + 1
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the next sampled position."""
        out, steps = np.zeros(len(rows), np.int64), 0
        at, live = rows.astype(np.int64), np.arange(len(rows))
        while len(live):
            done = self.marks[at + 1] > self.marks[at]
            out[live[done]] = self.samples[self.marks[at[done]]] + steps
            live, at = live[~done], at[~done]
            c = self.wavelet.access(at)
            at = self.before[c] + self.wavelet.rank(c, at)
            steps += 1
        return out
