"""Elias-Fano coded monotone sequences on numpy arrays, queried many values at once."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th (0-based) set bit of each 64-bit word."""
    at, rest = np.zeros(len(words), np.uint64), r.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = (words >> at) & np.uint64((1 << half) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        up = rest >= n
        rest = rest - np.where(up, n, 0)
        at = at + np.where(up, np.uint64(half), np.uint64(0))
    return at.astype(np.int64)


class EliasFano:
    """Strictly rising integers below 2 ** 63: low bits packed, high bits as unary counts per bucket."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width, self.first = (int(x) for x in arrays["head"])
        self.low, self.high, self.zeros = arrays["low"], arrays["high"], arrays["zeros"]
        self.buckets = int(self.zeros[-1])

    @staticmethod
    def build(values: np.ndarray, first: int = 0) -> dict[str, np.ndarray]:
        """Arrays of the sequence; `first` is subtracted from all values."""
        x = values.astype(np.uint64) - np.uint64(first)
        n, top = len(x), int(x[-1]) + 1 if len(x) else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            bit = np.arange(n, dtype=np.int64) * width
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            part = x & np.uint64((1 << width) - 1)
            np.add.at(low, word, part << shift)  # the bits are apart, so sums are unions
            over = shift + np.uint64(width) > np.uint64(64)
            np.add.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        high = (x >> np.uint64(width)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 1
        bits = np.zeros(-(-size // 64) * 64, bool)
        bits[high + np.arange(n)] = True
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
        return {"head": np.array([n, width, first], np.int64), "low": low, "high": words, "zeros": zeros.astype(np.uint32)}

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return (word << 6) + _select(~self.high[word], k - self.zeros[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        spill = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | spill) & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i, found by the number of ones up to each word."""
        ones = np.arange(1, len(self.zeros)) * 64 - self.zeros[1:].astype(np.int64) if not hasattr(self, "_ones") else self._ones
        self._ones = ones
        word = np.searchsorted(ones, i, side="right")
        before = np.where(word > 0, ones[word - 1], 0)
        at = (word << 6) + _select(self.high[word], i - before)
        return (((at - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)) + np.uint64(self.first)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Position of each value, -1 where the sequence lacks it: the successor within its bucket is compared."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        some = np.flatnonzero(x >= np.uint64(self.first))
        x = x[some] - np.uint64(self.first)
        bucket = x >> np.uint64(self.width)
        inside = bucket < np.uint64(self.buckets)
        some, x, bucket = some[inside], x[inside], bucket[inside].astype(np.int64)
        start = np.where(bucket > 0, self._select0(np.maximum(bucket - 1, 0)) - bucket + 1, 0)
        end = self._select0(bucket) - bucket
        want = x & np.uint64((1 << self.width) - 1)
        while len(some):
            going = start < end
            some, start, end, want = some[going], start[going], end[going], want[going]
            middle = (start + end) >> 1
            value = self._low(middle)
            hit = value == want
            out[some[hit]] = middle[hit]
            less = value < want
            start, end = np.where(less, middle + 1, start), np.where(less | hit, end, middle)
            some, start, end, want = some[~hit], start[~hit], end[~hit], want[~hit]
        return out
