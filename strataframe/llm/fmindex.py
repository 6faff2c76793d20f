"""FM-index over a sequence of word numbers, all queries answered in batches of numpy operations.

The Burrows-Wheeler transform comes from a suffix array by prefix doubling that re-sorts only what is still tied. Ranks
come from a wavelet matrix (one prefix-summed bit row per bit of the alphabet); places from suffix positions sampled at
every ``rate``-th text position and at each text's first, and a walk along the last-to-first mapping, which so never
crosses a separator.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` (numbers from 0); a suffix that is a prefix of another comes first."""
    n = len(text)
    if n == 0:
        return np.empty(0, "int64")
    bits = max(1, int(text.max() + 1).bit_length())
    depth = max(1, 62 // bits)
    padded = np.zeros(n + depth, "int64")
    padded[:n] = text + 1
    key = np.zeros(n, "int64")
    for k in range(depth):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(key[1:], key[:-1], out=first[1:])
    del key
    rank = np.empty(n + 1, "int64")
    rank[n] = -1
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = start
    tied = np.flatnonzero(~first | ~np.r_[first[1:], True])
    while len(tied):
        at = order[tied]
        group = rank[at]
        pair = group * (n + 1) + rank[np.minimum(at + depth, n)] + 1
        inner = np.argsort(pair)
        at, pair = at[inner], pair[inner]
        order[tied] = at
        fresh = np.empty(len(tied), bool)
        fresh[0] = True
        np.not_equal(pair[1:], pair[:-1], out=fresh[1:])
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[~fresh | ~np.r_[fresh[1:], True]]
        depth *= 2
    return order


class WaveletMatrix:
    """Ranks and symbols of a sequence by levels of bits, the highest first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        current = symbols.astype("int32")
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            total = np.zeros(len(bit) + 1, "int32")
            np.cumsum(bit, out=total[1:])
            self.ones.append(total)
            self.zeros.append(len(bit) - int(total[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        begin = np.zeros(size, "int64")
        self.begin = self._down(np.arange(size), begin)

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = self.ones[k][at]
            at = np.where((symbols >> (self.levels - 1 - k)) & 1, self.zeros[k] + one, at - one)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbols, at) - self.begin[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        symbol = np.zeros(len(at), "int64")
        for k in range(self.levels):
            one, nxt = self.ones[k][at], self.ones[k][at + 1]
            bit = nxt - one
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[k] + one, at - one)
        return symbol, at - self.begin[symbol]


class FMIndex:
    """Index of ``text`` with symbols below ``size``; 0 must only be used as a separator."""

    def __init__(self, text: np.ndarray, size: int, rate: int = 8):
        text = np.r_[text, 0]
        order = suffix_array(text)
        self.length = len(text)
        self.counts = np.r_[0, np.cumsum(np.bincount(text, minlength=size))].astype("int64")
        self.tree = WaveletMatrix(text[order - 1], size)
        kept = (order % rate == 0) | (text[order - 1] == 0)
        self.sampled = kept
        self.sample_rank = np.r_[0, np.cumsum(kept)].astype("int64")
        self.samples = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row ranges of all patterns (one per row, equal lengths) by backward search."""
        low = np.zeros(len(patterns), "int64")
        high = np.full(len(patterns), self.length, "int64")
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low[alive] = self.counts[c] + self.tree.rank(c, low[alive])
            high[alive] = self.counts[c] + self.tree.rank(c, high[alive])
            dead = low[alive] >= high[alive]
            high[alive[dead]] = low[alive[dead]]
            alive = alive[~dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        rows = rows.copy()
        found = np.empty(len(rows), "int64")
        steps = np.zeros(len(rows), "int64")
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.sampled[rows[open_]]
            done = open_[hit]
            found[done] = self.samples[self.sample_rank[rows[done]]] + steps[done]
            open_ = open_[~hit]
            symbol, before = self.tree.access(rows[open_])
            rows[open_] = self.counts[symbol] + before
            steps[open_] += 1
        return found % self.length
