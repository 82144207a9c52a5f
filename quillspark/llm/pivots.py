"""Hard-negative mining with a pivot table.

Components become whole numbers, so scores, inner products, are whole. Rows get one more component, sqrt(M^2 - |x|^2) with M
the largest norm, anchors get 0 there: then |q - x|^2 = |q|^2 + M^2 - 2 <q, x>, and the larger score is the smaller
distance. PIVOTS rows of a sample of SAMPLE rows, each the farthest from those before it, are pivots (rows of a length that
the sample lacks have the first axes); every row's distances to them are stored. By the triangle inequality they bracket an anchor's distance from
a row, from |d(q, p) - d(x, p)| to d(q, p) + d(x, p), and so its score.

Rows lie in blocks of BLOCK, in order of label, nearest pivot and distance from it; a block stores the least and largest
distance of its rows from each pivot. Anchors lie in such blocks too. Two blocks are compared only if the brackets of the
blocks leave room for a score that is wanted; in them, scores are computed only of pairs whose own brackets do, from the
vectors, exactly. Limits come from SEEDS blocks for each block of anchors, those that promise the largest scores: an anchor's
fifth best positive or tenth best negative found there. Blocks are rows of tables that Spark joins, so no task holds more
than a block of each side at a time, and a label with most rows is many blocks.

Defined cases: rows with null vec_id or label, a null or empty vector, or a null or non-finite component take no part; vectors
of other lengths only score with their own; rows with equal vec_id are rows of their own, as positives, negatives and
anchors, in the order of the table where they tie; scores are exact where they fit in a long, otherwise it is an error; an
empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, small_batches

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
PIVOTS, SAMPLE, BLOCK, SEEDS = 16, 4096, 1024, 2
#: Brackets are widened by this share of the squared distances' size, for rounding.
SLACK = 1e-9
FOUND = "qid long, q_at long, q_id long, turn int, at long, vec_id long, score long"
BLOCKS = "dim int, n int, first int, last int, kind string, ats binary, ids binary, labels binary, vectors binary, norms binary, dists binary, lo array<double>, hi array<double>, norm_lo double, norm_hi double"


def whole(vectors: list, scale: int) -> np.ndarray:
    return np.floor(scale * np.asarray(vectors, np.float64))


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """count rows of x, each the farthest from those before it; repeats if x has fewer."""
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < count:
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
        chosen.append(int(far.argmax()))
    return x[chosen]


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that makes all of them as long as most."""
    return np.concatenate([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))[:, None]], axis=1)


def pivots_of(sample: list, scale: int, most: float, count: int) -> dict[int, np.ndarray]:
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    return {d: farthest_first(augmented(whole(v, scale), most), count) for d, v in by_size.items()}


def _axes(dim: int, count: int, most: float) -> np.ndarray:
    out = np.zeros((count, dim + 1))
    out[np.arange(count), np.arange(count) % (dim + 1)] = np.sqrt(most)
    return out


def _measured(pivots: dict[int, np.ndarray], scale: int, most: float, count: int):
    """at, vec_id, label, anchor and embedding -> with the whole vector, its squared norm and its distances from the
    pivots, as a row and (anchors) as an anchor, and the nearest pivot."""

    def distances(x: np.ndarray) -> np.ndarray:
        p = pivots.get(x.shape[1] - 1)
        p = _axes(x.shape[1] - 1, count, most) if p is None else p
        square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T
        return np.sqrt(np.maximum(0.0, square))

    def run(batches):
        for b in batches:
            values = b.column("embedding").to_pylist()
            sizes = np.array([len(v) for v in values])
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x = whole([values[i] for i in own], scale)
                d = distances(augmented(x, most))
                asked = distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1))
                cells = d.argmin(axis=1)
                picked = [b.column(c).take(pa.array(own)) for c in ("at", "vec_id", "label", "anchor")]
                rest = [pa.array([int(dim)] * len(own), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array((x * x).sum(axis=1)), pa.array([r.tobytes() for r in d], pa.binary()), pa.array([r.tobytes() for r in asked], pa.binary()), pa.array(cells, pa.int32()), pa.array(d[np.arange(len(d)), cells])]
                yield pa.RecordBatch.from_arrays([*picked, *rest], ["at", "vec_id", "label", "anchor", "dim", "vector", "norm", "dists", "asked", "cell", "near"])

    return run


def _joined(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _packed(block: int, dists: str):
    """Rows in order -> a row for each block of at most block rows of one length."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            x, d = _joined(t.column("vector"), np.float64), _joined(t.column(dists), np.float64)
            labels, norms = t.column("label").to_numpy(), t.column("norm").to_numpy()
            size = np.abs(x).max()
            kind = "<i2" if size < 1 << 15 else "<i4" if size < 1 << 31 else "<f8"
            row = [x.shape[1], len(x), int(labels.min()), int(labels.max()), kind, t.column("at").to_numpy().tobytes(), t.column("vec_id").to_numpy().tobytes(), labels.astype(np.int32).tobytes(), x.astype(kind).tobytes(), norms.tobytes(), d.tobytes(), d.min(axis=0).tolist(), d.max(axis=0).tolist(), float(norms.min()), float(norms.max())]
            types = [pa.int32()] * 4 + [pa.string()] + [pa.binary()] * 6 + [pa.list_(pa.float64())] * 2 + [pa.float64()] * 2
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        dim, count = None, 0
        for b in batches:
            sizes = b.column("dim").to_numpy()
            at = 0
            while at < len(sizes):
                if held and (sizes[at] != dim or count == block):
                    yield flush()
                    count = 0
                dim = sizes[at]
                other = np.flatnonzero(sizes[at:] != dim)
                take = min(block - count, int(other[0]) if len(other) else len(sizes) - at)
                held.append(b.slice(at, take))
                count, at = count + take, at + take
        if held:
            yield flush()

    return run


def _blocks(rows: DataFrame, block: int, dists: str, parts: int) -> DataFrame:
    order = ["label", "dim", "cell", "near", "at"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = dealt.select("at", "vec_id", "label", "dim", "vector", "norm", dists).mapInArrow(_packed(block, dists), BLOCKS)
    return cut(packed.withColumn("block", F.monotonically_increasing_id()))


def _open_pairs(asked: DataFrame, blocks: DataFrame, most: float, same: bool) -> DataFrame:
    """qid and block of the pairs of blocks that may hold a positive (same) or a negative, with the least (worst) and
    largest (best) score that the blocks' brackets leave."""
    q = asked.select(F.col("block").alias("qid"), "dim", F.struct("first", "last", "lo", "hi", "norm_lo", "norm_hi").alias("q"))
    x = blocks.select("block", "dim", F.struct("first", "last", "lo", "hi").alias("x"))
    fits = (F.col("q.first") <= F.col("x.last")) & (F.col("x.first") <= F.col("q.last"))
    single = (F.col("q.first") == F.col("q.last")) & (F.col("x.first") == F.col("x.last")) & (F.col("q.first") == F.col("x.first"))
    both = x.join(q, "dim").where(fits if same else ~single)
    above = F.zip_with("q.lo", "x.hi", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    below = F.zip_with("x.lo", "q.hi", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    gap = F.greatest(F.array_max(above), F.array_max(below))
    reach = F.array_min(F.zip_with("q.hi", "x.hi", lambda a, b: a + b))
    slack = F.lit(SLACK) * (F.col("q.norm_hi") + F.lit(2 * most)) + 1
    return both.select("qid", "block", ((F.col("q.norm_hi") + most - gap * gap) / 2 + slack).alias("best"), ((F.col("q.norm_lo") + most - reach * reach) / 2 - slack).alias("worst"))


class _Side:
    """A block's arrays."""

    def __init__(self, row: dict, prefix: str):
        of = lambda c, t: np.frombuffer(row[prefix + c], t)
        self.n, self.dim = row[prefix + "n"], row["dim"]
        self.ats, self.ids, self.labels, self.norms = of("ats", np.int64), of("ids", np.int64), of("labels", np.int32), of("norms", np.float64)
        self.vectors, self.dists = of("vectors", row[prefix + "kind"]).reshape(self.n, -1).astype(np.float64), of("dists", np.float64).reshape(self.n, -1)


def brackets(q: _Side, x: _Side, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(worst, best) score of each pair, by the pivots alone."""
    gap, reach = np.zeros((q.n, x.n)), np.full((q.n, x.n), np.inf)
    for p in range(q.dists.shape[1]):
        a, b = q.dists[:, p, None], x.dists[None, :, p]
        np.maximum(gap, np.abs(a - b), out=gap)
        np.minimum(reach, a + b, out=reach)
    slack = SLACK * (q.norms[:, None] + 2 * most) + 1
    return (q.norms[:, None] + most - reach * reach) / 2 - slack, (q.norms[:, None] + most - gap * gap) / 2 + slack


def scores(q: _Side, x: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs (i, j)."""
    a, b = q.vectors, x.vectors
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * q.dim < 2**53:
        if len(i) * 16 > q.n * x.n:
            return (a @ b.T)[i, j].astype(np.int64)
        out = np.empty(len(i), np.int64)
        for s in range(0, len(i), 1 << 16):
            out[s : s + (1 << 16)] = np.einsum("ij,ij->i", a[i[s : s + (1 << 16)]], b[j[s : s + (1 << 16)]])
        return out
    exact = [sum(int(u) * int(v) for u, v in zip(a[k], b[m], strict=True)) for k, m in zip(i, j, strict=True)]
    return np.array(exact, np.int64)


def _firsts(i: np.ndarray, score: np.ndarray, ids: np.ndarray, ats: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k of each i: largest score, then smallest id, then smallest at."""
    order = np.lexsort((ats, ids, -score, i))
    starts = np.flatnonzero(np.diff(i[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    return order[rank < k]


def _found(qid: int, q: _Side, x: _Side, turn: int, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(i), qid), q.ats[i], q.ids[i], np.full(len(i), turn, np.int32), x.ats[j], x.ids[j], score]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in FOUND.split(", ")])


def _scan_positives(most: float, k: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                q, x = _Side(row, "q_"), _Side(row, "x_")
                _, best = brackets(q, x, most)
                least = np.full(q.n, -np.inf)
                if row["limits"]:
                    known = {m["q_at"]: m["least"] for m in row["limits"] if m["least"] is not None}
                    least = np.array([known.get(a, -np.inf) for a in q.ats.tolist()])
                i, j = np.nonzero((best >= least[:, None]) & (q.labels[:, None] == x.labels) & (q.ats[:, None] != x.ats))
                score = scores(q, x, i, j)
                keep = np.flatnonzero(score >= least[i])
                keep = keep[_firsts(i[keep], score[keep], x.ids[j[keep]], x.ats[j[keep]], k)]
                yield _found(row["qid"], q, x, 0, i[keep], j[keep], score[keep])

    return run


def _scan_negatives(most: float, k: int, low: int, high: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                q, x = _Side(row, "q_"), _Side(row, "x_")
                place = {a: i for i, a in enumerate(q.ats.tolist())}
                turns = 1 + max(m["turn"] for m in row["limits"])
                positive, least, has = np.zeros((q.n, turns), np.int64), np.full((q.n, turns), np.inf), np.zeros((q.n, turns), bool)
                for m in row["limits"]:
                    at = place[m["q_at"]], m["turn"]
                    positive[at], has[at] = m["positive"], True
                    least[at] = max(low * m["positive"] / 100, -np.inf if m["least"] is None else m["least"])
                most_wanted = np.where(has, high * positive / 100.0, -np.inf).max(axis=1)
                worst, best = brackets(q, x, most)
                i, j = np.nonzero((best >= least.min(axis=1)[:, None] - 1) & (worst <= most_wanted[:, None] + 1) & (q.labels[:, None] != x.labels))
                score = scores(q, x, i, j)
                for turn in range(turns):
                    p = positive[i, turn]
                    keep = np.flatnonzero(has[i, turn] & (low * p <= 100 * score) & (100 * score <= high * p) & (score >= least[i, turn]))
                    keep = keep[_firsts(i[keep], score[keep], x.ids[j[keep]], x.ats[j[keep]], k)]
                    yield _found(row["qid"], q, x, turn, i[keep], j[keep], score[keep])

    return run


def _compare(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, limits: DataFrame | None, scan) -> DataFrame:
    columns = ("n", "kind", "ats", "ids", "labels", "vectors", "norms", "dists")
    q = asked.select(F.col("block").alias("qid"), "dim", *(F.col(c).alias(f"q_{c}") for c in columns))
    q = q.join(limits, "qid") if limits is not None else q.withColumn("limits", F.lit(None).cast("array<struct<q_at:long,turn:int,positive:long,least:double>>"))
    x = blocks.select("block", *(F.col(c).alias(f"x_{c}") for c in columns))
    full = pairs.select("qid", "block").join(x, "block").join(q, "qid").drop("block")
    # as the blocks of one side come together by the joins, they are dealt anew, as rows of about a tenth of a megabyte
    spark = pairs.sparkSession
    with small_batches(spark, "16m"):
        return cut(full.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(scan, FOUND))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and turn; rank from 1."""
    order = Window.partitionBy("q_at", "turn").orderBy(F.col("score").desc(), "vec_id", "at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _seeds(pairs: DataFrame, seeds: int) -> tuple[DataFrame, DataFrame]:
    """The pairs that promise most for each block of anchors, and the others."""
    ranked = cut(pairs.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("best").desc(), "block"))))
    return ranked.where(F.col("_r") <= seeds), ranked.where(F.col("_r") > seeds)


def hard_negatives(
    vectors: DataFrame, anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, pivots: int = PIVOTS, block: int = BLOCK, seeds: int = SEEDS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. anchor: the condition on vec_id,
    label and embedding that makes a row an anchor. Its positives are the first rows of its label; the negatives of each, rows of
    other labels whose score is from low to high percent of the positive's."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long"), F.col("label").cast("int"), e.cast("array<double>").alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    most = rows.agg(F.max(norm)).first()[0]
    if most is None:
        most = 0.0
    most = most * (1 + 1e-12) + 1
    sample = [r[0] for r in rows.orderBy(F.xxhash64("vec_id", "at")).limit(SAMPLE).select("embedding").collect()]
    measured = "at long, vec_id long, label int, anchor boolean, dim int, vector binary, norm double, dists binary, asked binary, cell int, near double"
    table = cut(rows.mapInArrow(_measured(pivots_of(sample, scale, most, pivots), scale, most, pivots), measured))
    discard(rows)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(table.count() // (block * 4), 64 * parallel))
    blocks = _blocks(table, block, "dists", parts)
    asked = _blocks(table.where("anchor"), block, "asked", max(1, parts // 16))
    discard(table)

    pairs = _open_pairs(asked, blocks, most, same=True)
    first, rest = _seeds(pairs, seeds)
    scan = _scan_positives(most, positives)
    seeded = _compare(first, asked, blocks, None, scan)
    worst = _best(seeded, positives).where(F.col("rank") == positives).select("qid", "q_at", F.col("score").cast("double").alias("least"))
    limits = cut(worst.groupBy("qid").agg(F.collect_list(F.struct("q_at", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("positive"), "least")).alias("limits"), F.count("*").alias("known"), F.min("least").alias("floor")))
    # a block of anchors of which one has too few positives so far has no limit
    counts = asked.select(F.col("block").alias("qid"), "n")
    limits = cut(counts.join(limits, "qid", "left").select("qid", F.coalesce("limits", F.array().cast("array<struct<q_at:long,turn:int,positive:long,least:double>>")).alias("limits"), F.when(F.col("known") == F.col("n"), F.col("floor")).alias("floor")))
    rest = rest.join(limits.select("qid", "floor"), "qid").where(F.col("floor").isNull() | (F.col("best") >= F.col("floor")))
    more = _compare(rest, asked, blocks, limits.select("qid", "limits"), scan)
    chosen = cut(_best(seeded.unionByName(more), positives).select("qid", "q_at", "q_id", (F.col("rank") - 1).alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive")))

    def wanted(least: Column) -> Column:
        return F.collect_list(F.struct("q_at", "turn", "positive", least.alias("least"))).alias("limits")

    scan = _scan_negatives(most, negatives, low, high)
    none = chosen.groupBy("qid").agg(wanted(F.lit(None).cast("double")))
    first, rest = _seeds(_open_pairs(asked, blocks, most, same=False), seeds)
    seeded = _compare(first, asked, blocks, none, scan)
    worst = _best(seeded, negatives).where(F.col("rank") == negatives).select("q_at", "turn", F.col("score").cast("double").alias("least"))
    known = chosen.join(worst, ["q_at", "turn"], "left")
    needs = F.greatest(F.col("positive") * low / 100, F.coalesce("least", F.lit(float("-inf"))))
    limits = cut(known.groupBy("qid").agg(wanted(F.col("least")), F.min(needs).alias("floor"), F.max(F.col("positive") * high / 100).alias("ceiling")))
    rest = rest.join(limits.select("qid", "floor", "ceiling"), "qid").where((F.col("best") >= F.col("floor")) & (F.col("worst") <= F.col("ceiling")))
    more = _compare(rest, asked, blocks, limits.select("qid", "limits"), scan)
    out = _best(seeded.unionByName(more), negatives).join(chosen.select("q_at", "turn", "positive_id", "positive"), ["q_at", "turn"])
    return out.select(F.col("q_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("positive").alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.e) = len(v.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
