"""Sets of hashed word shingles, for whole columns at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_VALUE = _LOWER + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: Bytes that are hashed at a time: 8-byte arrays of more than that never arise, however long a text or a word is.
CHUNK = 1 << 18
_RANDOM = np.random.default_rng(20240229)
_PLACE = _RANDOM.integers(1 << 62, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, number of words of each text). A-Z are lower-cased; words stand between space and
    the characters 09 to 0D. Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    inside = ~_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][(offsets[:-1] < len(data))]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    sums = np.zeros(len(starts), np.uint64)
    for a in range(0, len(data), CHUNK):
        at = np.flatnonzero(inside[a : a + CHUNK])
        if not len(at):
            continue
        # words before the chunk are counted; a word that began there goes on, its sum is added to
        word = np.cumsum(begins[a : a + CHUNK], dtype=np.int64)[at] + (np.searchsorted(starts, a) - 1)
        place = at + a - starts[word]
        value = _VALUE[data[a : a + CHUNK][at]] * _PLACE[place & 4095]
        far = place >= 4096
        if far.any():
            value[far] *= mix((place[far] >> 12).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        edges = np.flatnonzero(np.diff(word, prepend=-1))
        sums[word[edges]] += np.add.reduceat(value, edges)
    return mix(sums), np.diff(np.searchsorted(starts, offsets))


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of size words; of all words where there are fewer; none without
    words."""
    hashes, counts = words(column)
    ends = np.cumsum(counts)
    all_runs = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= size:
        run = np.zeros(len(hashes) - size + 1, np.uint64)
        for k in range(size):
            run = run * _PLACE[k] + hashes[k : len(hashes) - size + 1 + k]
        all_runs[: len(run)] = mix(run)
    out = []
    for e, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(all_runs[e - n : e - size + 1]))
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in hashes[e - n : e]:
                    h = h * _PLACE[size] + x
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
