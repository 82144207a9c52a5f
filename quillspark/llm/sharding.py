"""Balanced label propagation: documents that link through a shared hub (here: equal texts) move to one shard.

Law ``rows``: shard counts differ by one at most. Documents without links only fill room. Linked documents start with
the label of their hash; in each round a hub's members move to the label that most of them have, among labels with
room, as far as the label's quota of rows goes: hubs are admitted by a hash threshold, so no round sorts. A hub that
holds more than a shard's quota is first divided by hash into pieces of that size; a piece is then a hub. After the
rounds, what stands above a shard's quota, and all documents without links, fill the free places in order.

Defined cases: null text counts as empty; equal rows are separate rows with a slot each; an empty table gives an empty
result; other columns are ignored."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless

ROWS_PER_BUCKET = 20_000


def _chosen(values: dict[int, float], col) -> F.Column:
    """A value for each shard, as an array literal: the number of shards is a parameter."""
    return F.element_at(F.array(*[F.lit(float(values[k])) for k in sorted(values)]), (col + 1).cast("int"))


def _propagate(state: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """state (hub, h, label, ...) of linked documents -> the same with labels after the rounds."""
    for r in range(rounds):
        votes = cut(state.groupBy("hub", "label").agg(F.count("*").alias("n")))
        load = {k: 0 for k in range(shards)} | {x["label"]: x["n"] for x in votes.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        over = {k: max(0, v - quota) for k, v in load.items()}
        room = [k for k, v in load.items() if v < quota]
        if r and not room:
            break
        # a label without room takes part for the members that it already has, as far as it isn't overfull
        strength = F.col("n") * F.when(F.lit(r == 0) | (_chosen({k: float(not over[k]) for k in load}, F.col("label")) > 0), 1.0).otherwise(1.0 - _chosen({k: over[k] / max(1, load[k]) for k in load}, F.col("label")))
        best = votes.groupBy("hub").agg(F.max_by("label", F.struct(strength, F.xxhash64("hub", "label"))).alias("best"), F.sum("n").alias("members"))
        if r:  # hubs whose best label is overfull look for another label, some of them, as far as it is overfull
            spare = F.element_at(F.array(*map(F.lit, room)), (F.pmod(F.xxhash64("hub", F.lit(r)), F.lit(len(room))) + 1).cast("int"))
            dice = F.pmod(F.xxhash64("hub", F.lit(-1 - r)), F.lit(1 << 20)) / float(1 << 20)
            best = best.withColumn("best", F.when(dice < _chosen({k: over[k] / max(1, load[k]) for k in load}, F.col("best")), spare).otherwise(F.col("best")))
        best = cut(best)
        want = votes.join(best, "hub").groupBy("best").agg(F.sum(F.when(F.col("label") == F.col("best"), F.col("n")).otherwise(0)).alias("stay"), F.sum("n").alias("all"))
        seen = {x["best"]: (x["stay"], x["all"] - x["stay"]) for x in want.collect()}
        admit = {k: 1.0 if not seen.get(k, (0, 0))[1] else max(0.0, min(1.0, (quota - seen[k][0]) / seen[k][1])) for k in range(shards)}
        lot = F.pmod(F.xxhash64("hub", F.lit(r + 1000)), F.lit(1 << 20)) / float(1 << 20)
        moves = best.withColumn("to", F.when(lot < _chosen(admit, F.col("best")), F.col("best"))).select("hub", "to")
        state = cut(state.join(moves, "hub").withColumn("label", F.coalesce("to", "label")).drop("to"))
    return state


def balanced_shards(docs: DataFrame, shards: int = 40, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("group"))
    base = cut(base.withColumn("h", F.xxhash64("doc_id", "text_crc32")))
    n = base.count()
    floor, extra = divmod(n, shards)
    quota = {k: floor + (k < extra) for k in range(shards)}
    piece = max(1, floor)
    groups = base.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1")
    # at most n / piece groups, that is as many as shards or so, are larger than a piece: these alone are broadcast
    large = F.broadcast(groups.filter(F.col("members") > piece).select("group", F.ceil(F.col("members") / piece).alias("pieces")))
    small = groups.filter(F.col("members") <= piece).select("group", F.lit(True).alias("linked"))
    marked = base.join(large, "group", "left")
    hot = marked.filter("pieces is not null").withColumn("hub", F.xxhash64("group", F.pmod("h", F.col("pieces"))))
    cold = marked.filter("pieces is null").join(small, "group", "left").withColumn("hub", F.when(F.col("linked"), F.col("group"))).drop("linked")
    nodes = cut(hot.unionByName(cold).drop("pieces", "group"))
    start = F.pmod(F.col("h"), F.lit(shards)).cast("int")
    linked = _propagate(nodes.filter("hub is not null").withColumn("label", start), shards, floor, rounds)

    buckets = max(1, math.ceil(n / shards / ROWS_PER_BUCKET))
    by_hub = linked.withColumn("b", F.pmod(F.xxhash64("hub"), F.lit(buckets)))
    ranked = cut(gapless(by_hub, ["label"], "b", ["hub", "h", "doc_id"], "place"))
    stays = F.col("place") < _chosen(quota, F.col("label"))
    kept = ranked.filter(stays).withColumn("shard", F.col("label")).select("doc_id", "size", "text_crc32", "h", "shard")
    held = {k: 0 for k in range(shards)} | {x["shard"]: x["n"] for x in kept.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    pool = ranked.filter(~stays).select("doc_id", "size", "text_crc32", "h", "hub").unionByName(nodes.filter("hub is null").select("doc_id", "size", "text_crc32", "h", "hub"))
    # those with a hub come first and together, so that they share the free places of few shards
    many = max(1, math.ceil(n / ROWS_PER_BUCKET))
    pool = pool.withColumn("b", F.when(F.col("hub").isNull(), F.lit(many) + F.pmod("h", F.lit(many))).otherwise(F.pmod("hub", F.lit(many)))).withColumn("one", F.lit(0))
    pool = gapless(pool, ["one"], "b", ["hub", "h", "doc_id"], "place")
    ends, total = [], 0
    for k in range(shards):
        total += quota[k] - held[k]
        ends.append(total)
    free = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("place")))
    placed = cut(kept.unionByName(pool.withColumn("shard", free.cast("int")).select("doc_id", "size", "text_crc32", "h", "shard")))
    out = gapless(placed.withColumn("b", F.pmod("h", F.lit(buckets))), ["shard"], "b", ["h", "doc_id", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
