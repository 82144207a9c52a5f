"""Golomb codes of sorted numbers, with a power of two as divisor.

The gaps between sorted numbers are divided by 2^k: quotients are written in unary, remainders in k bits. Both kinds of
bits stand together, so that whole arrays are coded and decoded without a step for each number."""

from __future__ import annotations

import numpy as np


def best_k(span: int, count: int) -> int:
    """The k for count numbers spread evenly below span: the mean gap, rounded down to a power of two."""
    return max(0, (span // max(1, count)).bit_length() - 1)


def encode(values: np.ndarray, k: int) -> bytes:
    """values: uint64, ascending without repeats, below 2^63."""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients) + np.arange(len(values))] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.concatenate([unary, rest.reshape(-1)])).tobytes()


def decode(code: bytes, count: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ones = np.flatnonzero(bits)[:count]  # the unary part has a one for each number
    quotients = np.diff(ones, prepend=-1) - 1
    begin = int(ones[-1]) + 1 if count else 0
    rest = bits[begin : begin + count * k].reshape(count, k).astype(np.uint64) @ (np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64)) if k else np.zeros(count, np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + rest, dtype=np.uint64)
