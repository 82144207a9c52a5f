"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document has a fixed 60-bit hash. The words of each source are summed by hash bucket; running sums over the
buckets give the bucket in which the source's budget ends, and only the documents of that bucket are summed again by
finer buckets, until it holds one hash. A document is then taken if its hash is below its source's threshold: no sort,
and a smaller budget takes a subset of what a larger one takes.

Defined cases: null or empty text has size 0; null source is a source of its own, the last; documents with equal
doc_id share a hash and are taken together within their source; a source whose texts have no words has size and target 0 and nothing is
taken of it; an empty table gives an empty result; ``mix_documents`` keeps other columns, whatever their names and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hash60, word_count

BITS, HASH_BITS = 10, 60


def source_targets(sizes: DataFrame, budgets: tuple[float, ...], weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(source, source_size) -> one row per source and budget with its target: shares by weight, none above
    max_repeat times its size, the excess reshared. The level that weights are multiplied with is found from running
    sums over the sources in order of cap / weight. One row per source: the windows hold no documents."""
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_repeat)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("_caps"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_left"),
        F.sum("source_size").over(every).alias("_total"),
    )
    s = s.select("*", F.posexplode(F.array(*map(F.lit, map(float, budgets)))).alias("budget_no", "budget"))
    s = s.withColumn("_level", (F.col("budget") * F.col("_total") - F.col("_caps")) / F.col("_left"))
    fits = F.when(F.col("cap") / F.col("weight") >= F.col("_level"), F.col("_level"))
    s = s.withColumn("_first", F.min(F.when(fits.isNotNull(), F.struct(F.col("cap") / F.col("weight"), F.col("_caps"), fits.alias("level")))).over(Window.partitionBy("budget_no")))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("_first.level") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", "weight", "budget_no", F.greatest(target, F.lit(0.0)).alias("target"))


def _boundaries(hist: DataFrame) -> DataFrame:
    """Per source and budget the bucket in which the budget ends."""
    upto = Window.partitionBy("source", "budget_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("_cum", F.col("acc") + F.sum("words").over(upto))
    h = h.filter((F.col("_cum") > F.col("rest")) & (F.col("_cum") - F.col("words") <= F.col("rest")))
    return h.select("source", "budget_no", "rest", "bucket", (F.col("_cum") - F.col("words")).alias("acc"), "words", "low", "high")


def _same_source(a: str, b: str):
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def thresholds(meta: DataFrame, targets: DataFrame) -> DataFrame:
    """meta (source, size, h) and targets -> per source and budget: full (whole repeats) and threshold (hashes below
    it get one repeat more)."""
    full = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    goal = cut(targets.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")))
    shift = HASH_BITS - BITS
    level = meta.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
    hist = level.alias("a").join(goal.alias("g"), _same_source("a", "g")).select("a.*", "g.budget_no", "g.rest", F.lit(0).cast("long").alias("acc"))
    edge = cut(_boundaries(hist))
    while shift > 0 and edge.filter("low < high").limit(1).count():
        at, shift = shift, shift - BITS
        done = edge.filter("low = high")
        inside = meta.alias("m").join(edge.filter("low < high").alias("e"), _same_source("m", "e") & (F.shiftright("m.h", at) == F.col("e.bucket")))
        hist = inside.groupBy("m.source", "e.budget_no", "e.rest", "e.acc", F.shiftright("m.h", shift).alias("bucket")).agg(F.sum("m.size").alias("words"), F.min("m.h").alias("low"), F.max("m.h").alias("high"))
        edge = cut(_boundaries(hist).unionByName(done))
    nearer = (F.col("e.acc") + F.col("e.words") - F.col("e.rest")) <= (F.col("e.rest") - F.col("e.acc"))
    return goal.alias("g").join(edge.alias("e"), _same_source("g", "e") & (F.col("g.budget_no") == F.col("e.budget_no")), "left").select(
        "g.source", "g.source_size", "g.budget_no", "g.target", "g.full", F.coalesce(F.when(nearer, F.col("e.high") + 1).otherwise(F.col("e.low")), F.lit(0)).alias("threshold")
    )


def _meta(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h")))


def _marks(meta: DataFrame, budgets: tuple[float, ...], weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """A row for each source: source, source_size and b, its budgets. It is written, so that Spark knows its size before it
    plans a join with it: below spark.sql.autoBroadcastJoinThreshold it is broadcast and documents aren't shuffled, else
    AQE splits hot sources."""
    sizes = meta.groupBy("source").agg(F.sum("size").alias("source_size"))
    marks = thresholds(meta, source_targets(sizes, budgets, weights, max_repeat))
    return cut(marks.groupBy("source", "source_size").agg(F.sort_array(F.collect_list(F.struct("budget_no", "target", "full", "threshold"))).alias("b")))


def _copies(b: Column, h: Column) -> Column:
    return F.transform(b, lambda x: x["full"] + (h < x["threshold"]).cast("long"))


def mix(docs: DataFrame, budgets: tuple[float, ...] = (0.25, 0.5, 1.0), weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies and taken (words) at the last budget, and
    first_budget, the number of the smallest budget that takes the document (null: none). Budgets are shares of all
    words, in ascending order."""
    meta = _meta(docs)
    marks = _marks(meta, budgets, weights, max_repeat)
    d = meta.alias("m").join(marks.alias("k"), _same_source("m", "k")).select("m.doc_id", "m.source", "m.size", "m.h", "k.source_size", "k.b")
    d = d.withColumn("_copies", _copies(F.col("b"), F.col("h"))).withColumn("copies", F.element_at("_copies", -1))
    first = F.array_position(F.transform("_copies", lambda x: x > 0), True)
    return d.select(
        "doc_id", "source", "size", "source_size", F.element_at("b", -1)["target"].alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"),
        F.when(first > 0, first - 1).cast("int").alias("first_budget"),
    )


def mix_documents(docs: DataFrame, budgets: tuple[float, ...] = (0.25, 0.5, 1.0), weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """The mix itself: each document as often as the last budget takes it, with all its columns. Documents without words
    are left out: they carry no weight."""
    marks = _marks(_meta(docs), budgets, weights, max_repeat)
    # the row is one column, so that no name of its own can clash
    worded = docs.where(F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    rows = worded.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source"), hash60(F.col("doc_id")).alias("h"))
    taken = rows.alias("m").join(marks.alias("k"), _same_source("m", "k")).select("m.row", F.element_at(_copies(F.col("k.b"), F.col("m.h")), -1).cast("int").alias("times"))
    return taken.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


ORACLE = """
WITH m AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM m GROUP BY source),
w AS (SELECT *, (turn % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
    coalesce(sum(cap) OVER b, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS lft, sum(source_size) OVER () AS total
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, unnest([0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS budget, unnest([0, 1, 2]) AS budget_no FROM r),
l AS (SELECT *, (budget * total::DOUBLE - caps::DOUBLE) / lft::DOUBLE AS lvl FROM x),
f AS (SELECT *, first_value(CASE WHEN ratio >= lvl THEN lvl END) OVER (PARTITION BY budget_no ORDER BY (ratio >= lvl) DESC, ratio, caps ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS chosen FROM l),
t AS (SELECT source, source_size, budget_no, greatest(least(cap::DOUBLE, coalesce(chosen * weight, cap::DOUBLE)), 0.0) AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS fll FROM t),
e AS (SELECT *, target - fll * source_size AS rest FROM g),
hh AS (SELECT source, h, sum(size)::BIGINT AS words FROM m GROUP BY source, h),
c AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY h))::BIGINT AS cum FROM hh),
k AS (
  SELECT e.source, e.budget_no, c.h, CASE WHEN c.cum - e.rest <= e.rest - (c.cum - c.words) THEN c.h + 1 ELSE c.h END AS threshold
  FROM e JOIN c ON e.source IS NOT DISTINCT FROM c.source AND c.cum > e.rest AND c.cum - c.words <= e.rest),
a AS (
  SELECT m.doc_id, m.source, m.size, e.source_size, e.target, e.budget_no, e.fll + CASE WHEN m.h < coalesce(k.threshold, 0) THEN 1 ELSE 0 END AS copies
  FROM m JOIN e ON m.source IS NOT DISTINCT FROM e.source LEFT JOIN k ON k.source IS NOT DISTINCT FROM e.source AND k.budget_no = e.budget_no)
SELECT doc_id, any_value(source) AS source, any_value(size) AS size, any_value(source_size) AS source_size,
  max(target) FILTER (budget_no = 2) AS target, max(copies) FILTER (budget_no = 2) AS copies, (any_value(size) * max(copies) FILTER (budget_no = 2))::BIGINT AS taken,
  (min(budget_no) FILTER (copies > 0))::INTEGER AS first_budget
FROM a GROUP BY doc_id
"""
