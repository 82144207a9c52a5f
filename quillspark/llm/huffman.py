"""Token ids as files: canonical length-limited Huffman codes, decoded by table in independent blocks.

A file image holds its code lengths, a table of its documents, the bit offset at which each block of ids begins, and
the bits. Blocks are decoded side by side, one id of each block at a time."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, LIMIT, BLOCK = b"QHUF", 18, 1024
HEAD = struct.Struct("<4sBIQQI")  # magic, limit, block, documents, ids, bytes of the packed code lengths


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code without a length above limit (package-merge); 0 where the count is 0."""
    out = np.zeros(len(counts), np.uint8)
    some = np.flatnonzero(counts)
    if len(some) <= 1:
        out[some] = 1
        return out
    if len(some) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = some[np.argsort(counts[some], kind="stable")]
    w = counts[order].astype(np.float64)
    leaves, current = [np.ones(len(w), bool)], w
    for _ in range(limit - 1):
        packs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([w, packs])
        by = np.argsort(both, kind="stable")
        current = both[by]
        leaves.append(by < len(w))
    need, lengths = 2 * len(w) - 2, np.zeros(len(w), np.uint8)
    for flags in reversed(leaves):
        k = int(flags[:need].sum())
        lengths[:k] += 1
        need = 2 * (need - k)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: by length, then by symbol, counting up."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - last
        own = np.flatnonzero(lengths == n)
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code, last = code + len(own), n
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, the bit at which each id begins)."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    n = lengths[ids].astype(np.int64)
    begins = np.cumsum(n) - n
    total = int(begins[-1] + n[-1])
    word, used = begins >> 6, begins & 63
    left = 64 - used - n
    value = codes[ids]
    high = np.where(left >= 0, value << np.maximum(left, 0).astype(np.uint64), value >> np.maximum(-left, 0).astype(np.uint64))
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(total // 64 + 2, np.uint64)
    words[word[firsts]] = np.add.reduceat(high, firsts)
    over = np.flatnonzero(left < 0)
    words[word[over] + 1] += value[over] << (64 + left[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], begins


def decode_table(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For each run of limit bits the symbol it begins with, times 32, plus that symbol's length."""
    out = np.zeros(1 << limit, np.uint32)
    codes = canonical(lengths).astype(np.int64)
    some = np.flatnonzero(lengths)
    some = some[np.lexsort((some, lengths[some]))]
    span = 1 << (limit - lengths[some].astype(np.int64))
    filled = np.repeat((some.astype(np.uint32) << 5) | lengths[some], span)
    start = int(codes[some[0]] << (limit - int(lengths[some[0]]))) if len(some) else 0
    out[start : start + len(filled)] = filled
    return out


def write_image(doc_ids: list, n_ids: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    bits, begins = pack_bits(ids, codes, lengths)
    book = zlib.compress(lengths.tobytes(), 1)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, LIMIT, BLOCK, len(doc_ids), len(ids), len(book))
    return b"".join((head, book, known.tobytes(), numbers.tobytes(), n_ids.astype("<u8").tobytes(), begins[::BLOCK].astype("<u8").tobytes(), bits))


_tables: dict[bytes, np.ndarray] = {}


class Image:
    """A file image: documents, and ids of all or of some blocks."""

    def __init__(self, data: bytes):
        magic, self.limit, self.block, docs, self.n_ids, book = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of this format")
        at = HEAD.size
        packed, at = data[at : at + book], at + book
        if packed not in _tables:
            _tables.clear()
            _tables[packed] = decode_table(np.frombuffer(zlib.decompress(packed), np.uint8), self.limit)
        self.table = _tables[packed]
        known, at = np.frombuffer(data, np.uint8, docs, at), at + docs
        numbers, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
        self.doc_ids = [int(x) if k else None for x, k in zip(numbers, known, strict=True)]
        self.lengths, at = np.frombuffer(data, "<u8", docs, at).astype(np.int64), at + 8 * docs
        blocks = -(-self.n_ids // self.block)
        self.checkpoints, at = np.frombuffer(data, "<u8", blocks, at).astype(np.int64), at + 8 * blocks
        b = np.frombuffer(data, np.uint8, offset=at)
        b = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.windows = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first to last - 1."""
        pos = self.checkpoints[first:last].copy()
        out = np.zeros((self.block, len(pos)), np.uint32)
        shift, mask = np.uint32(32 - self.limit), np.uint32(31)
        for i in range(self.block if len(pos) > 1 else min(self.block, self.n_ids - first * self.block)):
            np.minimum(pos, (len(self.windows) - 1) << 3, out=pos)  # the last block may be short
            e = self.table[(self.windows[pos >> 3] << (pos & 7).astype(np.uint32)) >> shift]
            out[i] = e >> np.uint32(5)
            pos += e & mask
        return out.T.reshape(-1)[: self.n_ids - first * self.block]

    def ids(self) -> np.ndarray:
        return self.blocks(0, len(self.checkpoints)) if self.n_ids else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from the blocks it lies in."""
        start = int(self.lengths[:k].sum())
        end = start + int(self.lengths[k])
        if end == start:
            return np.zeros(0, np.uint32)
        first = start // self.block
        return self.blocks(first, -(-end // self.block))[start - first * self.block : end - first * self.block]
