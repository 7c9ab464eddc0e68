"""Elias-Fano codes of monotone sequences in numpy, with vectorised access and successor search.

A value is split into its low `l` bits, packed, and its high part, written as a bit vector in which value i sets bit
high(i) + i. Selecting the k-th one gives a value back, selecting zeros gives the run of values that share a high part, so
that a search only compares low bits inside one run.

A level of a trie is such a code with the context as high part and the child as low bits: the bit vector then holds the
contexts' monotone pointers to their children, and `children` reads the two pointers of a context.
"""

from __future__ import annotations

import numpy as np


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit of each word: the half that holds it, six times."""
    x, k, at = words.copy(), k.astype(np.int64), np.zeros(len(words), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        own = np.bitwise_count(x & np.uint64((1 << step) - 1)).astype(np.int64)
        up = k >= own
        k -= own * up
        x >>= (up * np.uint64(step)).astype(np.uint64)
        at += up * step
    return at


def encode(values: np.ndarray, low_bits: int | None = None) -> dict[str, np.ndarray]:
    """Arrays of the code of a non-decreasing sequence of non-negative integers under 2**63; low_bits: the most compact if None."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    l = max(0, (top // max(1, n)).bit_length() - 1) if low_bits is None else low_bits
    high = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
    flags = np.zeros(-(-((top >> l) + n + 2) // 64) * 64, bool)
    flags[high] = True
    low = np.zeros(0, np.uint8)
    if l:
        step = 1 << 16  # a multiple of eight, so that the pieces end at bytes
        low = np.concatenate([np.zeros(0, np.uint8), *(np.packbits(np.unpackbits(values[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :l].ravel(), bitorder="little") for i in range(0, n, step))])
    low = np.concatenate((low, np.zeros(-len(low) % 8 + 16, np.uint8)))
    bits = np.packbits(flags, bitorder="little").view("<u8")
    ones = np.bitwise_count(bits).astype(np.int64)
    zeros = 64 * np.arange(len(bits)) - (np.cumsum(ones) - ones)
    return {"low": low.view("<u8"), "high": bits, "zeros": zeros, "shape": np.array([n, l], np.int64)}


class EliasFano:
    """A coded sequence; its arrays may be memory maps. zeros: the zero bits before each word of `high`."""

    def __init__(self, low, high, zeros, shape):
        self.low, self.high, self.zeros, (self.n, self.l) = low, high, zeros, map(int, shape)
        self.mask = np.uint64((1 << self.l) - 1)

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        w, s = at >> 6, (at & 63).astype(np.uint64)
        right = np.where(s > 0, self.low[w + 1] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
        return ((self.low[w] >> s) | right) & self.mask

    def values(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        i = np.asarray(i, np.int64)
        ones = 64 * np.arange(len(self.high)) - self.zeros
        w = np.searchsorted(ones, i, "right") - 1
        high = w * 64 + _select_in_word(self.high[w], i - ones[w]) - i
        return (high << self.l) | self.low_bits(i).astype(np.int64)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        k = np.maximum(high - 1, 0)
        w = np.searchsorted(self.zeros, k, "right") - 1
        return np.where(high > 0, w * 64 + _select_in_word(~self.high[w], k - self.zeros[w]) - k, 0)

    def children(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[begin, end) of the values with each high part: empty for one that does not occur."""
        far = (high >= 64 * len(self.high) - self.n - 1) | (high < 0)
        high = np.where(far, 0, high)
        lo = self._below(high)
        at = lo + high  # the bits from here on are ones for the values of this high part
        w, s = at >> 6, (at & 63).astype(np.uint64)
        bits = self.high[w] >> s
        run = np.bitwise_count(bits & ~(bits + np.uint64(1))).astype(np.int64)
        hi, over = lo + run, np.flatnonzero(run == 64 - s.astype(np.int64))  # a run that may go on in the next word
        if len(over):
            hi[over] = self._below(high[over] + 1)
        return np.where(far, 0, lo), np.where(far, 0, hi)

    def successor(self, low: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Position in [lo, hi), whose values share their high part, of the first one with these low bits, or -1."""
        lo, stop, hi, low = lo.copy(), hi, hi.copy(), low.astype(np.uint64)
        live = np.flatnonzero(hi - lo > 1)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.low_bits(mid) < low[live]
            up, down = live[less], live[~less]
            lo[up] = mid[less] + 1
            hi[down] = mid[~less]
            live = live[lo[live] < hi[live]]
        out, ok = np.full(len(low), -1, np.int64), np.flatnonzero(lo < stop)
        ok = ok[self.low_bits(lo[ok]) == low[ok]]
        out[ok] = lo[ok]
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value that equals x, or -1."""
        x = np.asarray(x, np.int64)
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        return self.successor(x & int(self.mask), *self.children(x >> self.l))
