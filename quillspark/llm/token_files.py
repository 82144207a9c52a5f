"""Documents as files of token ids in ascending doc_id order, and back.

Defined cases: null or empty text has the end id alone; null doc_id comes first; rows with equal doc_id all stay, in
the order of their ids; an empty table writes no file and reads back as empty; other columns are ignored. A file is a
row of a Parquet table in the shared folder, so that any store that Spark can reach will do."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import huffman
from .common import cut
from .tokens import encoder, slices, vocabulary_path

IDS_PER_FILE, IDS_PER_PARTITION = 1 << 20, 1 << 24
IDS = "doc_id long, n long, ids binary"


def _tokenize(path: str, spaces_count: bool, end_id: int, dtype: str):
    """Rows of documents (ids packed), and after them a row for each id that occurred: (id, count, null)."""

    def run(batches):
        enc, packer = encoder(path, spaces_count), zstandard.ZstdCompressor(level=1)
        totals = np.zeros(max(enc.size, end_id + 1), np.int64)
        for b in slices(batches, "text"):
            ids, n = enc.encode(b.column("text"))
            totals += np.bincount(ids, minlength=len(totals))
            totals[end_id] += len(n)
            ids, at = ids.astype(dtype), np.concatenate([[0], np.cumsum(n)])
            tail = np.array([end_id], dtype).tobytes()
            packed = [packer.compress(ids[at[i] : at[i + 1]].tobytes() + tail) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n + 1), pa.array(packed, pa.binary())], ["doc_id", "n", "ids"])
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some]), pa.nulls(len(some), pa.binary())], ["doc_id", "n", "ids"])

    return run


def _write(lengths: np.ndarray, dtype: str):
    codes = huffman.canonical(lengths)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        unpack = zstandard.ZstdDecompressor()
        docs, n, ids, held = [], [], [], 0

        def image():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([sum(n)], pa.int64()), pa.array([huffman.write_image(docs, np.array(n), np.concatenate(ids), lengths, codes)], pa.binary())],
                ["part", "seq", "n_ids", "image"],
            )

        for b in batches:
            for d, packed in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                own = np.frombuffer(unpack.decompress(packed.as_buffer()), dtype)
                docs.append(d), n.append(len(own)), ids.append(own)
                held += len(own)
                if held >= IDS_PER_FILE:
                    yield image()
                    seq, docs, n, ids, held = seq + 1, [], [], [], 0
        if docs:
            yield image()

    return run


def _read(batches):
    for b in batches:
        for part, seq, data in zip(b.column("part"), b.column("seq"), b.column("image"), strict=True):
            file = huffman.Image(data.as_buffer().to_pybytes())
            ids = file.ids().astype("<u4")
            ends = np.cumsum(file.lengths)
            crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, file.lengths, strict=True)]
            k = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * k, pa.int64()), pa.array([seq.as_py()] * k, pa.int64()), pa.array(file.doc_ids, pa.int64()), pa.array(ends - file.lengths), pa.array(file.lengths), pa.array(crc, pa.int64())],
                ["part", "seq", "doc_id", "rel", "n_tokens", "ids_crc32"],
            )


def write_files(docs: DataFrame, path: str | None = None, spaces_count: bool = True, end_id: int = 2) -> DataFrame:
    """The files: part, seq (their order), n_ids and image. The only thing that goes to the driver is the number of
    times each id occurs, bounded by the vocabulary."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    size = encoder(path, spaces_count).size
    dtype = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
    rows = cut(docs.select("doc_id", "text").mapInArrow(_tokenize(path, spaces_count, end_id, dtype), IDS), codec="none")
    found = rows.filter("ids is null").groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max(size, end_id + 1), np.int64)
    for x in found:
        counts[x["doc_id"]] = x["n"]
    lengths = huffman.code_lengths(counts)
    parts = max(1, int(counts.sum()) // IDS_PER_PARTITION + 1)
    # rows that share a doc_id, or have none, are dealt over partitions by what they hold
    order = [F.col("doc_id").asc_nulls_first(), F.crc32("ids")]
    ordered = rows.filter("ids is not null").repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    return cut(ordered.select("doc_id", "ids").mapInArrow(_write(lengths, dtype), "part long, seq long, n_ids long, image binary"), codec="none")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))  # a row for each file
    read = files.select("part", "seq", "image").mapInArrow(_read, "part long, seq long, doc_id long, rel long, n_tokens long, ids_crc32 long")
    return read.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")
