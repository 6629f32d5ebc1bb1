"""A compressed FM-index over word sequences: a bit-packed wavelet matrix of the BWT, and backward search on it.

The suffixes are sorted to a depth of at least DEPTH words, which is exact for patterns up to that length.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank of symbols in a sequence, log2(symbols) bits each plus a count for every 64 bits."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.n = len(sequence)
        self.levels = list(range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1))
        self.words, self.counts, self.zeros = [], [], []
        now = sequence
        for level in self.levels:
            bit = (now >> level & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.base = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, counts, zeros in zip(self.levels, self.words, self.counts, self.zeros, strict=True):
            block = at >> 6
            part = words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[block] + np.bitwise_count(part)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] is among the first at[i] of the sequence."""
        return self._descend(symbol, at) - self.base[symbol]


class FmIndex:
    """Of the sequence `text` (numbers from 0, 0 being the separator), for patterns of up to `depth` symbols.

    weights: of every position; what a pattern's occurrences are counted by. parents(rows) widens the
    interval of a pattern of `depth` symbols to that of its first depth - 1.
    """

    def __init__(self, text: np.ndarray, weights: np.ndarray, depth: int) -> None:
        n, symbols = len(text), int(text.max()) + 1
        rank, length, by_length = text.astype(np.int64), 1, {}
        order = np.argsort(rank, kind="stable")
        while True:
            by_length[length] = rank
            if length >= depth:
                break
            key = rank * (n + symbols + 1)
            key[: max(0, n - length)] += rank[length:] + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank, length = fresh, 2 * length
        self.order = order
        # Groups of rows that agree in depth - 1 symbols: two overlapping runs of a power of two.
        half = 1 << (depth - 1).bit_length() - 1
        left, right = by_length[half], np.zeros(n, np.int64)
        shift = depth - 1 - half
        right[: n - shift] = by_length[half][shift:]
        a, b = left[order], right[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.first, self.last = starts[group], np.append(starts[1:], n)[group]
        self.wavelet = WaveletMatrix(text[order - 1], symbols)
        counts = np.bincount(text, minlength=symbols)
        self.less = np.cumsum(counts) - counts
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns with a symbol put before them: one step of backward search."""
        base = self.less[symbol]
        return base + self.wavelet.rank(symbol, lo), base + self.wavelet.rank(symbol, hi)

    def parents(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[lo], self.last[lo]


def repeated_windows(texts: list[np.ndarray], weights: np.ndarray, width: int) -> list[np.ndarray]:
    """For each sequence, which of its windows of `width` have a total weight of two or more over all sequences.

    Every sequence is indexed and then streamed, last window first: backward search keeps the interval of the
    width - 1 words behind, so each window costs one step, whatever the number of its occurrences.
    """
    sizes = np.array([len(x) for x in texts])
    _, numbers = np.unique(np.concatenate(texts), return_inverse=True)
    ends = np.cumsum(sizes + 1) - 1  # a separator behind every sequence
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = numbers + 1
    index = FmIndex(text, np.repeat(weights, sizes + 1), width)
    windows = sizes - width + 1
    order = np.argsort(-windows, kind="stable")
    at, left = ends[order], windows[order]
    lo, hi = np.zeros(len(order), np.int64), np.full(len(order), len(text))
    for _ in range(width - 1):
        at = at - 1
        lo, hi = index.extend(text[at], lo, hi)
    found = [np.zeros(w, bool) for w in windows]
    hits = np.zeros((int(windows.max()), len(order)), bool)
    for i in range(len(hits)):
        k = int(np.searchsorted(-left, -i, "left"))
        at = at[:k] - 1
        lo, hi = index.extend(text[at], lo[:k], hi[:k])
        hits[i, :k] = index.weight[hi] - index.weight[lo] >= 2
        lo, hi = index.parents(lo)
    for j, text_number in enumerate(order):
        w = windows[text_number]
        found[text_number][:] = hits[:w, j][::-1]
    return found
