"""A wavelet tree of a sequence of numbers, level by level, that reports ranges for many queries at once."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """values: numbers from 0. Each level holds one bit of every number, the highest first, in the order of the level
    above with the zeros before the ones; zeros are counted up to each place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros = []
        for shift in range(self.bits - 1, -1, -1):
            one = (values >> shift) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For query q, every value in [low, high) at the places [begin, end): (q, value) of all queries. Places and values
        are narrowed together from level to level; a branch goes on only where it has places and may have values."""
        q = np.flatnonzero((begin < end) & (low < high))
        a, b, base = begin[q], end[q], np.zeros(len(q), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - level)
            a0, b0 = zeros[a], zeros[b]
            left = (a0 < b0) & (low[q] < base + half) & (high[q] > base)
            right = (b - b0 > a - a0) & (low[q] < base + 2 * half) & (high[q] > base + half)
            first = zeros[-1]
            q, a, b, base = (
                np.concatenate([q[left], q[right]]),
                np.concatenate([a0[left], first + (a - a0)[right]]),
                np.concatenate([b0[left], first + (b - b0)[right]]),
                np.concatenate([base[left], base[right] + half]),
            )
        times = b - a
        return np.repeat(q, times), np.repeat(base, times)
