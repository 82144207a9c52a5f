"""Shared pieces: where intermediate tables go, gapless ranks, Arrow helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: A word is a run of anything but space and the characters 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a temporary one in local mode, as in
    tests; an error on a cluster, whose executors wouldn't share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quill-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_asked: dict[str, int] = {}


def batches_of(spark: SparkSession, rows: int) -> None:
    """Arrow batches of at most so many rows from now on, fewer if the session asked for fewer at first: an executor and
    its Python workers hold whole texts of a batch or two at a time."""
    own = _asked.setdefault(spark.sparkContext.applicationId, int(spark.conf.get(_ARROW_ROWS)))
    spark.conf.set(_ARROW_ROWS, str(min(rows, own) if own > 0 else rows))


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: str):
    """Arrow batches of about so many bytes at most, for jobs that run inside: those of long rows have few."""
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, most)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def cut(df: DataFrame, codec: str = "snappy", by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{spark.sparkContext.applicationId}-tables", uuid.uuid4().hex)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing will read again."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(conf).delete(path, True)


def hash60(c: Column) -> Column:
    """60 bits of md5 of the value as text; null hashes as 'null'. Any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def gapless(df: DataFrame, group: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Adds ranks 0, 1, ... in each group, by bucket and then by order, without bringing a group into one task:
    buckets are counted, their counts summed up, and only rows of one bucket are sorted together."""
    counts = df.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)))
    return ranked.join(offsets, [*group, bucket]).withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_off", "_rn")


#: Parts that a key's rows are dealt over where a key may hold a large share of all rows.
SALTS = 4096


def with_group(rows: DataFrame, key: list[str], row_id: list[str], partial: dict[str, Column], merged: dict[str, Column]) -> DataFrame:
    """rows with aggregates of their key's rows, however many rows a key has: they are dealt over SALTS parts by row_id,
    aggregated in each part (partial), the parts' results by key (merged, over the columns of partial), and joined back
    by key and part. Null keys get null."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.lit(SALTS)))
    parts = salted.where(" and ".join(f"`{k}` is not null" for k in key)).groupBy(*key, "_salt").agg(*(v.alias(k) for k, v in partial.items()))
    whole = parts.groupBy(*key).agg(*(v.alias(k) for k, v in merged.items()))
    return salted.join(parts.select(*key, "_salt").join(whole, key), [*key, "_salt"], "left").drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
