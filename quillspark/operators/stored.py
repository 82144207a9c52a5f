"""Tables that are written in parts: upserts that rewrite the buckets of their keys alone, and writes to two stores that
count as one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, new_path

BUCKETS = 64


@dataclass
class BucketedTable:
    """Rows by a hash of their key in `buckets` partitions. upsert() reads, merges and writes only the partitions that new
    keys fall into; files of the others stay as they are. The merged rows are written beside the table first, and then take
    the place of the partitions that they were read from, so a merge that gives the same when it is repeated can be repeated
    after a failure."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    buckets: int = BUCKETS

    @classmethod
    def create(cls, rows: DataFrame, key: tuple[str, ...], path: str | None = None, buckets: int = BUCKETS) -> BucketedTable:
        out = cls(rows.sparkSession, path or new_path(rows.sparkSession, "stores"), key, buckets)
        out._dealt(rows).write.partitionBy("bucket").parquet(out.path)
        return out

    def _dealt(self, rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        return dealt.repartition("bucket")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """merge gets the stored rows of the buckets that new falls into, and new; it returns what these buckets hold."""
        new = cut(self._dealt(new))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # as many as buckets at most
        if not touched:
            return
        old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched)).drop("bucket")
        merged = cut(self._dealt(merge(old, new.drop("bucket"))))
        merged.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)


@dataclass
class TwoStores:
    """Batches of rows in several tables that are seen together or not at all. A batch is written to a partition of its own
    in each table and then, last, to the list of commits; readers see the batches on that list. A batch that stopped
    between two tables isn't seen; written again under its number it replaces what is there. A batch that is on the list is
    not written again, so a caller may repeat one that it isn't sure of."""

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None) -> TwoStores:
        out = cls(spark, path or new_path(spark, "stores"))
        spark.createDataFrame([], "batch string").write.parquet(f"{out.path}/commits")
        return out

    def committed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/commits").distinct()

    def write(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """Whether the batch was written; False if it was there already."""
        if self.committed().where(F.col("batch") == batch).limit(1).count():
            return False
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch string").write.mode("append").parquet(f"{self.path}/commits")
        return True

    def read(self, name: str) -> DataFrame | None:
        """The rows of the committed batches; None before the first."""
        try:
            rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None
        return rows.withColumn("batch", F.col("batch").cast("string")).join(F.broadcast(self.committed()), "batch", "left_semi").drop("batch")
