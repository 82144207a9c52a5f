"""Components of a link relation that is found through shared keys, without all pairs of a group.

Items that may link share a key. First, in a few rounds, each item is tested against one leader of its keys' items, so
that groups of near copies become components by as many tests as they have items. What then may still link lies in
keys whose items are in several components: there every item outside the key's largest component is tested against all
items of other components. Pairs within a component need no test: they change nothing. So no link between different
components is lost, and none is made that wasn't tested."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

Verify = Callable[[DataFrame], DataFrame]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp), comp the smallest node reachable. Smallest labels of neighbours are taken and labels of
    labels looked up, so that the number of rounds grows with the logarithm of a component's width."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("comp").alias("least"))
        new = labels.join(near, "node").select("node", "comp", F.least("comp", "least").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("comp").alias("jump"))
        new = cut(new.join(up, "new").select("node", F.col("comp").alias("old"), F.least("new", "jump").alias("comp")))
        if not new.filter("old <> comp").limit(1).count():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _merge(comps: DataFrame, verified: DataFrame) -> DataFrame:
    """comps (id, c), with the components of verified pairs (a, b) made one."""
    ends = verified.join(comps.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(comps.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    edges = cut(ends.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if not edges.limit(1).count():
        return comps
    joined = components(edges)
    return cut(comps.join(joined, comps["c"] == joined["node"], "left").select("id", F.coalesce("comp", "c").alias("c")))


def link_components(postings: DataFrame, verify: Verify, may_link: Callable[[str, str], Column] | None = None, rounds: int = 2, central: Column | None = None) -> DataFrame:
    """postings (key, id, ...) of items that share a key with another -> (id, c) for these items, c the smallest id of the
    component. verify gets pairs (a, b) and returns those that link. may_link gives a condition on two postings, by
    their names, that linked items meet for one of their shared keys at least. The first leader of a key is the item
    with the least central, where that is given; other leaders are taken by a hash."""
    carried = [c for c in postings.columns if c not in ("key", "id")]
    comps = cut(postings.select("id").distinct().withColumn("c", F.col("id")))
    allowed = may_link or (lambda x, y: F.lit(True))
    for r in range(rounds):
        p = postings.join(comps, "id")
        leaders = p.groupBy("key").agg(F.min_by(F.struct("id", "c", *carried), F.struct(*([central] if central is not None and r == 0 else []), F.xxhash64("id", F.lit(r)))).alias("_l"), F.min("c").alias("_lo"), F.max("c").alias("_hi"))
        leaders = leaders.filter("_lo <> _hi").select("key", "_l.*")
        pairs = p.alias("x").join(leaders.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & allowed("x", "y"))
        pairs = pairs.groupBy("x.id", F.col("y.id").alias("leader")).agg(F.count("*").alias("n")).groupBy("id").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader"))
        tested = cut(pairs.select(F.col("id").alias("a"), F.col("leader").alias("b")))
        comps = _merge(comps, verify(tested))
        discard(tested)
    p = cut(postings.join(comps, "id"))
    sizes = p.groupBy("key", "c").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("largest"), F.count("*").alias("several")).filter("several > 1").select("key", "largest")
    mixed = cut(p.join(largest, "key"))
    discard(p)
    outside = mixed.filter("c <> largest")
    # a pair outside the largest component on both sides comes once
    once = (F.col("y.c") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id"))
    pairs = outside.alias("x").join(mixed.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & once & allowed("x", "y"))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    return _merge(comps, verify(cut(pairs)))
