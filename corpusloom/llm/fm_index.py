"""An FM-index of a shard of word ids: suffix order, wavelet matrix of the transform, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(tokens: np.ndarray) -> np.ndarray:
    """Suffix array of tokens, the last of which is 0. A 0 ends comparison: zeros order before all else, by position.

    Prefix doubling that sorts again only what is still tied.
    """
    n = len(tokens)
    keys = np.sort((tokens.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64))
    order = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    symbol = keys >> np.uint64(32)
    fresh = np.ones(n, bool)
    fresh[1:] = (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0)
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    active = order[tied]
    h = 1
    while len(active):
        keys = (rank[active].astype(np.uint64) << np.uint64(32)) | rank[active + h].astype(np.uint64)
        by = np.argsort(keys)
        keys, active = keys[by], active[by]
        at = np.arange(len(keys))
        new_old = np.ones(len(keys), bool)
        new_old[1:] = (keys[1:] >> np.uint64(32)) != (keys[:-1] >> np.uint64(32))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        old_start = np.maximum.accumulate(np.where(new_old, at, 0))
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = (keys >> np.uint64(32)).astype(np.int64) + start - old_start
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        active = active[tied]
        h *= 2
    order[rank] = np.arange(n)
    return order


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Symbols of a sequence with rank and access, one bit level at a time."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(width - 1, -1, -1):
            ones = ((symbols >> shift) & 1).astype(bool)
            zeros = symbols[~ones]
            self.levels.append((shift, Bits(ones), len(zeros)))
            symbols = np.concatenate([zeros, symbols[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol among the first i."""
        start = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            low, high = bits.rank(start), bits.rank(i)
            start = np.where(one, zeros + low, start - low)
            i = np.where(one, zeros + high, i - high)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = bits.get(i)
            ones = bits.rank(i)
            symbol |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return symbol


class FMIndex:
    """tokens: ids from 1, and 0 wherever no phrase can run through; the last is 0."""

    def __init__(self, tokens: np.ndarray, symbols: int):
        order = suffix_order(tokens)
        self.size = len(tokens)
        before = tokens[order - 1]
        self.matrix = WaveletMatrix(before.astype(np.int64), max(1, int(symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=symbols + 1))])
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled = Bits(sampled)
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases (rows of equal length) by backward search; empty where low >= high."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column]
            low[live] = self.first[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.matrix.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in tokens of suffix rows: steps back to the nearest sampled one."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled.get(rows))
        while len(live):
            symbol = self.matrix.access(rows[live])
            rows[live] = self.first[symbol] + self.matrix.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.sampled.get(rows[live])]
        return self.samples[self.sampled.rank(rows)] + steps
