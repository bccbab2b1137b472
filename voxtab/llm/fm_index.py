"""An FM-index over numbers, in numpy: backward search and location of many patterns at once."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling of the compared length.

    Stops as soon as all ranks differ, that is after about log2 of the longest
    repeat. The last symbol must be the only smallest one.
    """
    order = np.argsort(symbols, kind="stable")
    step = symbols[order]
    rank = np.empty(len(symbols), np.int64)
    rank[order] = np.cumsum(np.r_[False, step[1:] != step[:-1]])
    width, n = 1, len(symbols)
    while rank[order[-1]] < n - 1:
        behind = np.zeros(n, np.int64)
        behind[:max(0, n - width)] = rank[width:] + 1
        pair = rank * (n + 1) + behind
        order = np.argsort(pair, kind="stable")
        step = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, step[1:] != step[:-1]])
        width *= 2
    return order


class WaveletMatrix:
    """Ranks of numbers by one bit vector per binary digit, highest digit first."""

    def __init__(self, values: np.ndarray, top: int):
        self.digits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for d in reversed(range(self.digits)):
            bit = (values >> d) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.start: dict = {}

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before each place, counted from its block's start."""
        low = np.zeros_like(at)
        for level, d in enumerate(reversed(range(self.digits))):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = ((value >> d) & 1).astype(bool)
            at = np.where(bit, zeros + ones[at], at - ones[at])
            low = np.where(bit, zeros + ones[low], low - ones[low])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
            value = value * 2 + bit
        return value


class FMIndex:
    """Finds every place of every pattern in a sequence of positive numbers."""

    def __init__(self, symbols: np.ndarray, top: int):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.before = np.concatenate(
            [[0], np.cumsum(np.bincount(text, minlength=top + 2))]).astype(np.int64)
        self.tree = WaveletMatrix(text[order - 1], top)
        marked = order % SAMPLE_EVERY == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]

    def _back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, row)

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of each pattern; patterns are rows padded on the right."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for step in range(int(sizes.max(initial=0))):
            live = np.flatnonzero((sizes > step) & (low < high))
            symbol = patterns[live, sizes[live] - 1 - step]
            low[live], high[live] = self._back(symbol, low[live]), self._back(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: walk back until a sampled one."""
        rows, place = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            hit = self.marks[at + 1] > self.marks[at]
            place[left[hit]] += self.samples[self.marks[at[hit]]]
            left = left[~hit]
            if len(left):
                rows[left] = self._back(self.tree.access(rows[left]), rows[left])
                place[left] += 1
        return place

    def find(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pattern number and place of every occurrence."""
        low, high = self.search(patterns, sizes)
        counts = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(patterns)), counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return which, self.locate(rows + low[which])
