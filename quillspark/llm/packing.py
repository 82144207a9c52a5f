"""Lexical retrieval packing: sequences are filled with documents that a BM25 index finds near their seed.

Documents are tokenised once and written with the number of documents that hold each id (over all documents). They are
dealt by content into shards of about DOCS_PER_SHARD documents: in the order of a weighted min-hash of their terms, so
that related documents, copies above all, lie together at any size of the corpus. Each shard builds an inverted index
over token ids and packs its own documents, so a seed's neighbours come from its shard alone; the README has the
measured share of whole-corpus neighbours that lie there. A seed opens a window, its strongest terms are looked up, and unused neighbours follow in order
of their BM25 score until the window is full. The neighbour that crosses its end is cut; its rest opens the next window
and is its seed. The ids left at the end of a shard go to sequences whose lengths are powers of two. So no sequence is
padded.

Defined cases: null or empty text is the end id alone; rows with equal doc_id are packed each, so that their pieces
repeat (doc_id, start); null doc_id is kept; documents without a neighbour are followed by the next unused one; an
empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .shingles import mix
from .tokens import drop_held, encoder, release, slices, vocabulary_path

WINDOW, DOCS_PER_SHARD = 4096, 1024
#: Sampled keys for each shard: their order gives the bounds between shards.
SAMPLED = 16
#: Bytes of text that a worker encodes at a time, and words whose ids it keeps.
SLICE, CACHED = 1_600_000, 200_000
K1, B = 1.2, 0.75
#: One of so many documents makes a term a common one, in shards of so many documents.
COMMON, TABLED = 8, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _distinct(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The distinct ids of a document, without a sort. place is room for a number for each id of the vocabulary."""
    at = np.arange(len(ids), dtype=np.int32)
    place[ids] = at
    return ids[place[ids] == at]


def distinct_terms(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, times) of each distinct id of each document, in order: one sort for all documents, whose ids follow
    each other in ids."""
    bits, narrow = (16, len(lengths) <= 1 << 16) if ids.dtype.itemsize <= 2 else (32, False)
    kind = np.uint32 if narrow else np.uint64
    keys = np.repeat(np.arange(len(lengths), dtype=kind) << kind(bits), lengths) | ids.astype(kind)
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    times = np.diff(first, append=len(keys))
    keys = keys[first]
    return (keys >> kind(bits)).astype(np.int64), (keys & kind((1 << bits) - 1)).astype(np.int64), times


def _tokenize(path: str, end_id: int, dtype: str):
    """Rows of documents: (doc_id, n, ids); after them a row for each id: (id, documents that hold it, null)."""

    def run(batches):
        enc, packer = encoder(path, False, CACHED), zstandard.ZstdCompressor(level=1)
        holds, end = np.zeros(max(enc.size, end_id + 1), np.int64), np.array([end_id], dtype).tobytes()
        for b in slices(batches, "text", SLICE):
            ids, n = enc.encode(b.column("text"))
            ids, at = ids.astype(dtype, copy=False), np.concatenate([[0], np.cumsum(n)])
            _, term, _ = distinct_terms(ids, n)
            holds += np.bincount(term, minlength=len(holds))
            holds[end_id] += len(n) - np.count_nonzero(term == end_id)  # every document has it at its end
            raw, at = ids.tobytes(), (at * ids.itemsize).tolist()
            packed = [packer.compress(raw[i:j] + end) for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n + 1), pa.array(packed, pa.binary())], ["doc_id", "n", "ids"])
        some = np.flatnonzero(holds)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(holds[some]), pa.nulls(len(some), pa.binary())], ["doc_id", "n", "ids"])

    return run


def content_keys(docs: list[np.ndarray], ties: np.ndarray, idf: np.ndarray, mean_length: float) -> np.ndarray:
    """A number for each document whose order puts related ones together: the three terms that win a race with their
    squared BM25 weights as rates, 16 bits each, and 16 bits of ties, which divide groups of copies of any size."""
    race = -np.log((mix(np.arange(1, len(idf) + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
    out = np.zeros(len(docs), np.uint64)
    document, t, w = weights(docs, idf, mean_length)
    time = race[t] / np.maximum(w.astype(np.float64) ** 2, 1e-12)
    starts = np.searchsorted(document, np.arange(len(docs)))
    some = np.flatnonzero(np.diff(starts, append=len(document)))
    for _ in range(3):  # a document with fewer terms has zeros behind them
        low = np.full(len(docs), np.inf)
        low[some] = np.minimum.reduceat(time, starts[some]) if len(some) else np.inf
        won = np.flatnonzero((time == low[document]) & (time < np.inf))
        won = won[np.diff(document[won], prepend=-1) > 0]
        out <<= np.uint64(16)
        out[document[won]] |= t[won].astype(np.uint64) & np.uint64(0xFFFF)
        time[won] = np.inf
    return out << np.uint64(16) | ties.astype(np.uint64) & np.uint64(0xFFFF)


def weights(docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, BM25 weight) of the distinct ids of all documents, in order."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    document, t, times = distinct_terms(np.concatenate(docs) if docs else np.zeros(0, np.uint16), lengths)
    tf, norm = times.astype(np.float32), (K1 * (1 - B + B * lengths / mean_length)).astype(np.float32) if docs else lengths
    return document, t, idf[t] * tf * (K1 + 1) / (tf + norm[document])


def _weights(ids: np.ndarray, idf: np.ndarray, mean_length: float, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document in order and their BM25 weights: weights() for one document, without its sort."""
    t = np.sort(_distinct(ids, place))
    place[t] = np.arange(len(t), dtype=np.int32)
    tf = np.bincount(place[ids]).astype(np.float32)
    return t, idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length))


class Index:
    """A BM25 inverted index over the documents of one shard, with statistics of all documents. A term that one of COMMON
    documents holds has its weights as a row of a table instead, zero where a document lacks it."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        o, t, w = weights(docs, idf, mean_length)
        self.queries = np.split(t, np.searchsorted(o, np.arange(1, len(docs))))
        self.n = self.held = len(docs)
        # in the types that bincount takes without a copy
        w, df = w.astype(np.float64), np.bincount(t, minlength=len(idf))
        common = np.flatnonzero(df >= self.n / COMMON) if self.n >= TABLED else t[:0]
        self.row, self.columns = np.full(len(idf), -1), np.arange(self.n)
        self.row[common] = np.arange(len(common))
        self.table, row = np.zeros((len(common), self.n)), self.row[t]
        self.table[row[row >= 0], o[row >= 0]] = w[row >= 0]
        o, t, w = (x[row < 0] for x in (o, t, w))
        by = np.argsort(t.astype(np.uint16) if len(idf) <= 1 << 16 else t, kind="stable")
        self.owners, self.weights = o[by], w[by]
        self.bounds = np.searchsorted(t[by], np.arange(len(idf) + 1))

    def shrink(self, unused: np.ndarray) -> None:
        """Drops what belongs to used documents, for good, once they are a quarter of what is held; the order of the rest,
        and so every sum, stays."""
        if unused.sum() >= 0.75 * self.held:
            return
        keep = unused[self.owners]
        self.bounds = np.concatenate([[0], np.cumsum(keep)])[self.bounds]
        self.owners, self.weights, self.held = self.owners[keep], self.weights[keep], int(unused.sum())
        self.table, self.columns = self.table[:, unused[self.columns]], self.columns[unused[self.columns]]

    def neighbours(self, k: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with k, best first; ties by place."""
        t = self.queries[k]
        row = self.row[t]
        rare = t[row < 0]
        at = [slice(i, j) for i, j in zip(self.bounds[rare].tolist(), self.bounds[rare + 1].tolist(), strict=True)] or [slice(0)]
        score = np.zeros(self.n)
        score[self.columns] = self.table[row[row >= 0]].sum(0)
        score += np.bincount(np.concatenate([self.owners[x] for x in at]), np.concatenate([self.weights[x] for x in at]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    index, unused = Index(docs, idf, mean_length), np.ones(len(docs), bool)
    out: list[list[int]] = []
    sequence, fill, following, cursor, total = 0, 0, [], 0, sum(map(len, docs))
    whole = total // window * window  # ids in full windows; after them come powers of two
    placed, room, seed = 0, (window if whole else 1 << (total.bit_length() - 1)), -1
    for _ in docs:
        if fill == 0 and seed < 0 or not len(following):
            following = index.neighbours(seed, unused) if seed >= 0 else following
        following = following[unused[following]] if len(following) else following
        if len(following):
            k = int(following[0])
        else:
            while not unused[cursor]:
                cursor += 1
            k = cursor
        unused[k] = False
        index.shrink(unused)
        if fill == 0:  # it opens a window
            seed, following = k, index.neighbours(k, unused)
        at = 0
        while at < len(docs[k]):
            n = min(room - fill, len(docs[k]) - at)
            out.append((k, at, n, sequence, fill))
            at, fill, placed = at + n, fill + n, placed + n
            if fill == room:
                sequence, fill, left = sequence + 1, 0, total - placed
                room = window if placed < whole else 1 << max(0, left.bit_length() - 1)
                if at < len(docs[k]):  # its rest opens the next window
                    seed, following = k, index.neighbours(k, unused)
    return out


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, window: int = WINDOW, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """A row for each piece. To the driver go the number of documents of each id, bounded by the vocabulary, sums,
    and the keys of a sample, SAMPLED for each shard."""
    path = path or vocabulary_path("word_bpe_49k.json")
    size = max(encoder(path, False, CACHED).size, end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    with small_batches(docs.sparkSession, "8m"):
        rows = cut(docs.select("doc_id", "text").mapInArrow(_tokenize(path, end_id, dtype), "doc_id long, n long, ids binary"), codec="none")
    holds = np.zeros(size, np.int64)
    for x in rows.filter("ids is null").groupBy("doc_id").agg(F.sum("n").alias("n")).collect():
        holds[x["doc_id"]] = x["n"]
    whole = rows.filter("ids is not null")
    n_docs, n_ids = whole.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    idf = np.log1p((n_docs - holds + 0.5) / (holds + 0.5)).astype(np.float32)
    mean_length = n_ids / max(1, n_docs)

    def keyed(bounds: np.ndarray | None):
        """Rows with their shard, or the content keys alone where there are no bounds yet."""

        def run(batches):
            unpack = zstandard.ZstdDecompressor()
            drop_held()  # words aren't needed any more
            for b in batches:
                ids = [np.frombuffer(unpack.decompress(x.as_buffer()), dtype) for x in b.column("ids")]
                keys = content_keys(ids, b.column("tie").to_numpy(), idf, mean_length)
                if bounds is None:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, keys, side="right")), *(b.column(c) for c in ("doc_id", "n", "ids"))], ["shard", "doc_id", "n", "ids"])
            release()

        return run

    # rows that repeat have ties of their own, so that they are dealt over shards too
    tied = whole.withColumn("tie", F.xxhash64("doc_id", F.crc32("ids"), F.monotonically_increasing_id()))
    bounds = np.zeros(0, np.uint64)
    if n_docs > docs_per_shard:  # the sample is chosen by hash: equal tables have equal bounds
        one_of = max(1, docs_per_shard // SAMPLED)
        some = tied.filter(F.pmod(F.xxhash64("tie"), F.lit(one_of)) == 0).mapInArrow(keyed(None), "key long").toArrow()
        bounds = np.sort(some.column("key").to_numpy().view(np.uint64))[:: max(1, docs_per_shard // one_of)][1:]

    def packed(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        drop_held()
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(unpack.decompress(x), dtype) for x in table.column("ids").to_pylist()]
        shard, numbers = table.column("shard")[0].as_py(), table.column("doc_id").combine_chunks()
        pieces = np.array(pack_shard(ids, idf, mean_length, window), np.int64).reshape(-1, 5)
        crcs = [zlib.crc32(ids[k][a : a + n].astype("<u4")) for k, a, n, _, _ in pieces.tolist()]
        columns = [numbers.take(pa.array(pieces[:, 0])), pieces[:, 1], pieces[:, 2], crcs, np.array([len(x) for x in ids], np.int64)[pieces[:, 0]], (shard << 32) | pieces[:, 3], pieces[:, 4]]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])

    dealt = tied.mapInArrow(keyed(bounds), "shard long, doc_id long, n long, ids binary")
    return dealt.groupBy("shard").applyInArrow(packed, PIECES)
