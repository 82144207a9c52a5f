"""Exact dedup by an exchange of Golomb-coded fingerprints.

Texts stay where they are until they are under suspicion:

1. Each row's digest is written beside its place (file and row number), without the text.
2. Senders, a stretch of a file each, sort the fingerprints of their rows, the digests' first bits, and send them to the
   owners of ranges of fingerprints as Golomb-coded gaps, each fingerprint once however often it repeats in the stretch.
3. Owners compare the lists and reply with a bitmap for each: set where another sender has the fingerprint too.
4. Replies, and repeats within a stretch, become bitmaps of the files' rows. These go to the scan of the texts by
   broadcast, in waves of files of WAVE_BITMAPS bitmaps (64 MB) at most; only rows whose bit is set are shuffled, to be
   grouped by their bytes. Fingerprints have SLACK bits more than the rows need to differ, so about one row in 2^SLACK
   is suspected for nothing; grouping by bytes clears it.

A common text comes once from each sender, and its copies are summed in each task before the shuffle. Groups larger than
a thousandth of all rows, fewer than a thousand, are joined back by broadcast, the others by digest.

Defined cases: a null text is an empty one; texts are equal when their bytes are; of equal texts exactly one row is kept,
that of the largest doc_id (null is the smallest), of rows that share it the last by place; keep_id of null doc_ids alone is
null; an empty table gives an empty result; other columns are ignored, whatever their names."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .golomb import best_k, decode, encode

#: Bits beyond those that number the rows; rows of a sender; fingerprints of an owner, about; bitmaps of a broadcast.
SLACK, SENDER_ROWS, OWNER_ROWS, WAVE_BITMAPS = 16, 1 << 20, 1 << 18, 1 << 14
MESSAGES = "file long, owner long, first long, n int, k int, code binary, opens binary, places binary"


#: Steps that keep each row of a file one row.
STEADY = {"Project", "Filter", "Relation", "SubqueryAlias", "View"}


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), file and row of every row. Rows that aren't those of files are written first."""
    steps = re.findall(r"^[ :+-]*'?(\w+)", docs._jdf.queryExecution().analyzed().toString(), re.M)
    if "_metadata" in docs.columns or not STEADY.issuperset(steps):
        return placed(cut(docs.select("doc_id", "text")))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _sent(bits: int, owner_bits: int):
    """Batches of file, row and digest -> a message for each stretch of a file and owner. places are the rows' numbers
    less the stretch's first, in order of fingerprints; opens has a bit for each, set at the first row of a fingerprint."""
    low = np.uint64(bits - owner_bits)

    def message(file: int, rows: np.ndarray, prints: np.ndarray):
        order = np.lexsort((rows, prints))
        rows, prints = rows[order], prints[order]
        owners = (prints >> low).astype(np.int64)
        first = int(rows.min())
        for a, b in zip(cuts := np.flatnonzero(np.diff(owners, prepend=-1)), [*cuts[1:], len(rows)], strict=True):
            own = prints[a:b]
            opens = np.diff(own, prepend=own[0] + np.uint64(1)) != 0
            distinct = own[opens] & ((np.uint64(1) << low) - np.uint64(1))
            k = best_k(1 << int(low), len(distinct))
            yield file, int(owners[a]), first, len(distinct), k, encode(distinct, k), np.packbits(opens).tobytes(), (rows[a:b] - first).astype(np.uint32).tobytes()

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at, count = None, 0

        def flush():
            found = list(message(at, *(np.concatenate(x) for x in zip(*held, strict=True))))
            held.clear()
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], [c.split()[0] for c in MESSAGES.split(", ")])

        for b in batches:
            files, rows = b.column("file").to_numpy(), b.column("row").to_numpy()
            heads = np.frombuffer(b"".join(b.column("head").to_pylist()), ">u8").astype(np.uint64) >> np.uint64(64 - bits)
            for a, e in zip(cuts := np.flatnonzero(np.diff(files, prepend=0) | (np.arange(len(files)) == 0)), [*cuts[1:], len(files)], strict=True):
                if held and (files[a] != at or count + e - a > SENDER_ROWS):
                    yield flush()
                    count = 0
                at = int(files[a])
                held.append((rows[a:e], heads[a:e]))
                count += e - a
        if held:
            yield flush()

    return run


def _replied(messages: pa.Table) -> pa.Table:
    """The messages of one owner -> the bitmaps of those that share a fingerprint with another."""
    lists = [decode(c, n, k) for c, n, k in zip(messages.column("code").to_pylist(), messages.column("n").to_pylist(), messages.column("k").to_pylist(), strict=True)]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    marks = [np.isin(x, twice, assume_unique=True) for x in lists]
    keep = pa.array([bool(m.any()) for m in marks])
    bits = pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())
    return messages.select(["file", "owner", "first"]).append_column("bits", bits).filter(keep)


def _suspects(batches):
    """Messages with their replies -> file and row of each row whose fingerprint another row has."""
    for b in batches:
        out = []
        for first, n, opens, places, bits in zip(*(b.column(c).to_pylist() for c in ("first", "n", "opens", "places", "bits")), strict=True):
            rows = np.frombuffer(places, np.uint32).astype(np.int64) + first
            turn = np.cumsum(np.unpackbits(np.frombuffer(opens, np.uint8))[: len(rows)]) - 1
            mark = np.bincount(turn, minlength=n) > 1
            if bits is not None:
                mark |= np.unpackbits(np.frombuffer(bits, np.uint8))[:n].astype(bool)
            out.append(rows[mark[turn]])
        if out:
            files = np.repeat(b.column("file").to_numpy(), [len(x) for x in out])
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(np.concatenate(out))], ["file", "row"])


def _waves(bitmaps: DataFrame, limit: int) -> int:
    """Into how many waves files are dealt so that none has more than limit bitmaps; a file isn't divided."""
    waves = -(-bitmaps.count() // limit)
    while waves > 1:
        most, files = bitmaps.groupBy(F.pmod("file", F.lit(waves)).alias("w")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).select(F.struct("n", "files").alias("s")).agg(F.max("s")).first()[0]
        if most <= limit or files == 1:
            break
        waves *= 2
    return max(1, waves)


def dedup(docs: DataFrame, wave_bitmaps: int = WAVE_BITMAPS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    spark = docs.sparkSession
    texts = placed(docs)
    slim = cut(texts.select("doc_id", "file", "row", _digest().alias("digest")))
    n = max(1, slim.count())
    bits = min(63, n.bit_length() + SLACK)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner_bits = min(bits - 1, max(n // OWNER_ROWS, 2 * parallel).bit_length())
    sent = cut(slim.select("file", "row", F.substring("digest", 1, 8).alias("head")).mapInArrow(_sent(bits, owner_bits), MESSAGES))
    replies = sent.select("file", "owner", "first", "n", "k", "code").groupBy("owner").applyInArrow(_replied, "file long, owner long, first long, bits binary")
    answered = sent.select("file", "owner", "first", "n", "opens", "places").join(replies, ["file", "owner", "first"], "left")
    rows = answered.mapInArrow(_suspects, "file long, row long")
    place = F.col("row") + 1
    bitmaps = cut(rows.groupBy("file", F.bitmap_bucket_number(place).alias("stretch")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")))
    discard(sent)

    waves, parts = _waves(bitmaps, wave_bitmaps), []
    for w in range(waves):
        mine = F.pmod("file", F.lit(waves)) == w
        own = texts.where(mine).withColumn("stretch", F.bitmap_bucket_number(place)).join(F.broadcast(bitmaps.where(mine)), ["file", "stretch"])
        at = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring("bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        set_ = F.getbit(byte, (at % 8).cast("int")) == 1
        # the digest comes first in the sort, so bytes are compared of equal digests alone
        same = own.where(set_).select("doc_id", "file", "row", "text", _digest().alias("digest")).groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("last"), F.count("*").alias("size"))
        parts.append(cut(same.select("digest", "last", "size")))
    groups = parts[0]
    for p in parts[1:]:
        groups = groups.unionByName(p)
    if waves > 1:
        groups = groups.groupBy("digest").agg(F.max("last").alias("last"), F.sum("size").alias("size"))
    groups = cut(groups.where("size > 1"))
    discard(bitmaps, *parts)

    large = groups.where(F.col("size") > n // 1000)
    hot = slim.join(F.broadcast(large), "digest")
    rest = slim.join(F.broadcast(large.select("digest")), "digest", "left_anti").join(groups.where(F.col("size") <= n // 1000), "digest", "left")
    out = hot.unionByName(rest)
    alone = F.col("size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("last.file") == F.col("file")) & (F.col("last.row") == F.col("row")))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
