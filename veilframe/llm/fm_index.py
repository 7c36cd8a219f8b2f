"""An FM-index over a sequence of words: counts and places of a phrase without reading the sequence again.

The Burrows-Wheeler transform of the sequence is kept as a wavelet matrix (one row of packed bits a level, with running
counts), so the rank of any symbol at any row takes one step a level. Suffix positions are kept for one place in
``SAMPLE`` and for the first place of each document; other rows walk backwards to one of these. All steps work on whole
arrays of phrases or rows.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class Bits:
    """Packed bits with running counts a word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.pad(packed, (0, 8 - len(packed) % 8 + 8)).view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, Bits, int]] = []
        rest = symbols
        for bit in range(max(int(symbols.max()).bit_length() if len(symbols) else 0, 1) - 1, -1, -1):
            ones = (rest >> bit) & 1 > 0
            self.levels.append((bit, Bits(ones), len(rest) - int(np.count_nonzero(ones))))
            rest = np.concatenate([rest[~ones], rest[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        begin = np.zeros_like(at)
        for bit, ones, zeros in self.levels:
            right = (symbol >> bit) & 1 > 0
            a, b = ones.rank(at), ones.rank(begin)
            at, begin = np.where(right, zeros + a, at - a), np.where(right, zeros + b, begin - b)
        return at - begin

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol, begin = np.zeros_like(at), np.zeros_like(at)
        for bit, ones, zeros in self.levels:
            right, a, b = ones.get(at), ones.rank(at), ones.rank(begin)
            symbol += right.astype(np.int64) << bit
            at, begin = np.where(right, zeros + a, at - a), np.where(right, zeros + b, begin - b)
        return symbol, at - begin


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Where the suffixes begin, in order. Zeros end documents; each is a symbol of its own, in order of place.

    Suffixes are sorted by their first few symbols, then those still tied by twice as many, and so on. No tie outlasts
    its document, so copies cost the logarithm of their length.
    """
    n, ends = len(sequence), sequence == 0
    codes = np.where(ends, np.cumsum(ends) - 1, sequence + np.count_nonzero(ends))
    width = max(int(codes.max()).bit_length(), 1)
    seen = max(63 // width, 1)
    key = codes.copy()
    for step in range(1, min(seen, n)):
        key <<= width
        key[: n - step] |= codes[step:]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    slots, key = np.arange(n), key[order]
    while len(slots):
        first = np.r_[True, key[1:] != key[:-1]]
        rank[order[slots]] = np.maximum.accumulate(np.where(first, slots, 0))
        slots = slots[~(first & np.r_[first[1:], True])]
        tied = order[slots]
        key = rank[tied] * n + rank[tied + seen]
        sort = np.argsort(key)
        order[slots], key = tied[sort], key[sort]
        seen *= 2
    return order


class FMIndex:
    """Over a sequence of symbols from 1 up, each document ended by a 0."""

    def __init__(self, sequence: np.ndarray):
        order = suffix_order(sequence)
        last = sequence[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(sequence))]
        self.last = WaveletMatrix(last)
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.sampled, self.places = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) whose suffixes begin with each phrase (one a row of symbols above 0), from its end backwards."""
        low, high = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        for at in range(phrases.shape[1] - 2, -1, -1):
            live = np.flatnonzero(low < high)
            symbol = phrases[live, at]
            low[live] = self.first[symbol] + self.last.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.last.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the sequence the suffixes of these rows begin."""
        place, row, walking = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(walking):
            there = self.sampled.get(row)
            place[walking[there]] = self.places[self.sampled.rank(row[there])] + steps
            walking, row = walking[~there], row[~there]
            symbol, before = self.last.get(row)
            row = self.first[symbol] + before
            steps += 1
        return place
