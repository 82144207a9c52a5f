"""Streams: blocks of arriving texts, windowed figures of runtime logs, log upserts, and the hot turns of sessions.

Narrow operators (blocks, classes, planner rules) take a streaming DataFrame as it is. What aggregates has a watermark,
so its state is bounded by the windows that may still change; what keeps state for a session keeps a bounded number of
turns and forgets sessions that have been silent for long."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.blocks import line_blocks
from ..operators.graph import upsert_logs

HOT = "session string, turn long, role string, text string, place int"


def texts(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files: int = 100) -> DataFrame:
    """Rows of the JSON files that arrive in a folder, at most so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def block_stream(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The blocks of arriving texts: narrow, without state."""
    return line_blocks(docs, key, text)


def log_figures(logs: DataFrame, at: str, keys: list[str], latency: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests, mean and largest latency of each window and key; rows later than `late` don't count any more."""
    w = F.window(at, window)
    return logs.withWatermark(at, late).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("requests"), F.avg(latency).alias("mean_latency"), F.max(latency).alias("max_latency"))


def upsert_batches(logs: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, key: list[str], order: list[str], fixed: list[str], changing: list[str]) -> StreamingQuery:
    """Merges each batch of logs into the table that read gives, by upsert_logs, and hands the result to write. A batch
    that comes again after a failure gives the same table: rows that are in it already change nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        both = read().withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
        write(upsert_logs(both, key, [*order, "_new"], fixed, changing))

    return logs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hot_turns(turns: DataFrame, most: int = 30, forget: str = "1 day") -> DataFrame:
    """The last `most` turns of a session each time that it has new ones: (session, turn, role, text, place). State is
    these turns alone; it goes when a session has been silent for `forget`."""
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [tuple(r) for r in zip(*state.get, strict=True)] if state.exists else []
        for b in batches:
            held += list(b[["turn", "role", "text"]].itertuples(index=False, name=None))
            held = sorted(set(held), key=lambda r: r[0])[-most:]
        state.update(tuple(list(c) for c in zip(*held, strict=True)))
        state.setTimeoutDuration(wait)
        yield pd.DataFrame([(key[0], t, r, x, i + 1) for i, (t, r, x) in enumerate(held)], columns=[c.split()[0] for c in HOT.split(", ")])

    kept = "turns array<long>, roles array<string>, texts array<string>"
    return turns.groupBy("session").applyInPandasWithState(step, HOT, kept, "update", GroupStateTimeout.ProcessingTimeTimeout)
