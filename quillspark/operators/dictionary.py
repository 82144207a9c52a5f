"""Names of a stored dictionary that stand in texts: many terms against many texts without a test of every pair.

A map of bits holds hashes of the names, and of their beginnings of 1, 2, 4, ... characters. Tasks hash all places of their
texts together, doubling the length, and keep the places where the map has the beginning and then the whole name; what they
cut out there is counted within the text and joined with the dictionary, so a hash decides nothing. Only names that stand in
a text leave its task. The map has BITS_A_NAME bits for each name, up to MOST_BITS: a larger dictionary lets more through to
the join. Defined cases: null and empty texts and names match nothing; names may overlap and repeat; a name counts once for
each place; places are counted in code points; equal rows of the dictionary count once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from ..shipping import ship

BITS_A_NAME, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 27
#: code points that a task hashes at a time
STEP = 1 << 20
A, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashes(chars: str, longest: int):
    """p and the hashes of all runs of p code points, for p = 1, 2, 4, ... up to longest."""
    h, p = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), "<u4") * C, 1
    while p <= longest and len(h):
        yield p, h
        h = h[:-p] * A + h[p:]
        h ^= h >> np.uint64(29)
        p *= 2


def _spot(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Places in the map; kind tells beginnings (0) from whole names (their length)."""
    x = (h + np.uint64(kind * int(C) % (1 << 64))) * A
    return ((x >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _whole(h: np.ndarray, at: np.ndarray, p: int, size: int) -> np.ndarray:
    """Hashes of runs of size code points, p <= size < 2 p, by their first and last p."""
    return h[at] * C + h[at + (size - p)]


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def _spots_of_names(bits: int, longest: int):
    def run(batches):
        for b in batches:
            names = [_text(x) for x in b.column(0).to_pylist()]
            size = np.array([len(x) for x in names], np.int64)
            start, out = np.cumsum(size) - size, []
            for p, h in _hashes("".join(names), longest):
                out.append(_spot(h[start[size >= p]], 0, bits))
                for n in np.unique(size[(size >= p) & (size < 2 * p)]).tolist():
                    out.append(_spot(_whole(h, start[size == n], p, n), n, bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)) if out else [], pa.int64())], ["spot"])

    return run


def _pieces(texts: list, longest: int):
    """Groups of about STEP code points: row, first place, characters and the number of places that belong to the piece. A
    long text is cut into pieces that share what a name may need."""
    group, n = [], 0
    for row, value in enumerate(texts):
        t = _text(value)
        for at in range(0, len(t), STEP):
            group.append((row, at, t[at : at + STEP + longest - 1], min(STEP, len(t) - at)))
            n += len(group[-1][2])
            if n >= STEP:
                yield group
                group, n = [], 0
    if group:
        yield group


def _places(group: list, sizes: list[int], has: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The group's characters; place in them, length and piece of every run that may be a name, by place."""
    chars, length = "".join(g[2] for g in group), np.array([len(g[2]) for g in group], np.int64)
    end, own = np.cumsum(length), np.array([g[3] for g in group], np.int64)
    at, found = None, [np.zeros((2, 0), np.int64)]
    for p, h in _hashes(chars, sizes[-1]):
        if 2 * p <= sizes[0]:
            continue
        if at is None:
            at = np.flatnonzero(has[_spot(h, 0, len(has))])
        else:
            at = at[at < len(h)]
            at = at[has[_spot(h[at], 0, len(has))]]
        for n in (n for n in sizes if p <= n < 2 * p):
            here = at[at + (n - p) < len(h)]
            here = here[has[_spot(_whole(h, here, p, n), n, len(has))]]
            found.append(np.stack([here, np.full(len(here), n)]))
    at, n = np.concatenate(found, axis=1)
    piece = np.searchsorted(end, at, side="right")
    start = end - length
    keep = (at + n <= end[piece]) & (at - start[piece] < own[piece])
    order = np.flatnonzero(keep)[np.argsort(at[keep], kind="stable")]
    return chars, at[order], n[order], piece[order]


def _mentions(packed: np.ndarray, sizes: list[int], columns: list[str]):
    def run(batches):
        has = np.unpackbits(packed, bitorder="little").view(bool)
        for b in batches:
            for group in _pieces(b.column(1).to_pylist(), sizes[-1]):
                chars, at, n, piece = _places(group, sizes, has)
                seen: dict[tuple[int, str], list[int]] = {}
                for a, k, g in zip(at.tolist(), n.tolist(), piece.tolist()):
                    name = (g, chars[a : a + k])
                    if name in seen:
                        seen[name][1] += 1
                    else:
                        seen[name] = [a, 1]
                pieces = np.array([g for g, _ in seen], np.int64)
                start = np.cumsum([0, *(len(g[2]) for g in group)])[pieces]
                first = np.array([a for a, _ in seen.values()], np.int64) - start + np.array([g[1] for g in group], np.int64)[pieces]
                rows = pa.array(np.array([g[0] for g in group], np.int64)[pieces])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([w for _, w in seen], pa.string()), pa.array(first, pa.int32()), pa.array([k for _, k in seen.values()], pa.int64())], columns)

    return run


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """key, name, first (place from 0) and n (places) of each name in each text. Case counts."""
    spark = texts.sparkSession
    ship(spark)
    known = cut(names.select(F.col(name).alias("name")).where("name <> ''").distinct())
    count, sizes = known.agg(F.count("*"), F.collect_set(F.length("name"))).first()
    if not count:
        return texts.select(key, F.lit("").alias("name"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("n")).limit(0)
    sizes = sorted(sizes)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (count * BITS_A_NAME - 1).bit_length()))
    # the map is put together by tasks in parts of 4 KB, of which the driver gets MOST_BITS at most
    spots = known.select(F.col("name").cast("binary")).mapInArrow(_spots_of_names(bits, sizes[-1]), "spot long").select((F.col("spot") + 1).alias("spot"))
    parts = spots.groupBy(F.bitmap_bucket_number("spot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    packed = np.zeros((bits >> 15, 4096), np.uint8)
    for r in parts.collect():
        packed[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    columns = [key, "name", "first", "n"]
    schema = texts.select(F.col(key), F.lit("").alias("name"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("n")).schema
    found = texts.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(_mentions(packed.reshape(-1), sizes, columns), schema)
    return found.join(known, "name", "left_semi").groupBy(key, "name").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
