"""Where intermediate tables and indexes go: the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode, as in tests; an error on a cluster, whose
    executors wouldn't share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quill-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, kind: str) -> str:
    return os.path.join(shared_dir(spark), f"{spark.sparkContext.applicationId}-{kind}", uuid.uuid4().hex)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends in files that outlive any executor."""
    path = new_path(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
