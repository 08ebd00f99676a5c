"""FM-index of a sequence of word numbers, with numpy: suffix order, wavelet matrix, sampled suffix positions.

Built for one shard inside a task and searched for many phrases at once, each step of backward search being a few array
operations over all phrases that still have occurrences.
"""

from __future__ import annotations

import numpy as np

SAMPLED = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling ranks. Zeros are separators, each less than the ones after it, so no two suffixes are equal."""
    n = len(symbols)
    zeros = symbols == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, symbols.astype(np.int64) + zeros.sum())
    width = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:]
        key = rank * (n + int(rank.max()) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Counts of a symbol before a position, for arrays of symbols and positions."""

    def __init__(self, symbols: np.ndarray):
        self._levels = max(1, int(symbols.max(initial=0)).bit_length())
        self._ones: list[np.ndarray] = []
        for level in range(self._levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self._ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        begin = np.zeros_like(at)
        for depth, ones in enumerate(self._ones):
            bit = (symbol >> (self._levels - 1 - depth)) & 1
            zeros = len(ones) - 1 - ones[-1]
            begin = np.where(bit == 1, zeros + ones[begin], begin - ones[begin])
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return at - begin


class FMIndex:
    """Of word numbers from 1 on; 0 separates stretches, and none of a phrase's occurrences holds one."""

    def __init__(self, symbols: np.ndarray):
        symbols = np.append(symbols, 0)
        order = suffix_order(symbols)
        self._last = symbols[order - 1]  # the word before each suffix
        self._wavelet = WaveletMatrix(self._last)
        counts = np.bincount(symbols)
        self._before = np.concatenate([[0], np.cumsum(counts)])
        # the first words of stretches too: separators are in order of position, which steps back can't follow
        sampled = (order % SAMPLED == 0) | (self._last == 0)
        self._sampled, self._positions = np.concatenate([[0], np.cumsum(sampled)]), order[sampled]
        self._is_sampled = sampled

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase; phrases are rows of word numbers, aligned to the right."""
        n, width = phrases.shape
        low, high = np.zeros(n, np.int64), np.full(n, self._before[-1], np.int64)
        live = np.arange(n)
        for step in range(1, width + 1):
            live = live[(lengths[live] >= step) & (high[live] > low[live])] if step > 1 else live[lengths >= 1]
            word = phrases[live, width - step]
            known = word < len(self._before) - 1
            high[live[~known]] = low[live[~known]]
            live, word = live[known], word[known]
            low[live] = self._before[word] + self._wavelet.rank(word, low[live])
            high[live] = self._before[word] + self._wavelet.rank(word, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: steps back to the next sampled position, and their number added."""
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            done = self._is_sampled[rows]
            out[open_[done]] = self._positions[self._sampled[rows[done]]] + steps
            open_, rows = open_[~done], rows[~done]
            word = self._last[rows]
            rows = self._before[word] + self._wavelet.rank(word, rows)
            steps += 1
        return out
