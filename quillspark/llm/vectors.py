"""Embedding near-dedup with randomised-rotation binary codes.

Vectors are scaled to length 1, padded and rotated by a fixed random rotation. Of each distinct vector a code is stored:
four bits a dimension, whose first is the sign, with the step of the four bits and a correction factor, the inner product
of the vector with its own signs. For the signs x of one vector with factor f and the four-bit form y of another,
<x, y> / f estimates their cosine without bias; its error is within ERRORS standard deviations,
sqrt((1 - f^2) / (f^2 (dim - 1)) + step^2 / (12 f^2)), but for a chance of about one in a million. Each pair is estimated both
ways from the codes alone. Pairs whose smaller upper bound is below the threshold are dropped; only for the others are
the vectors fetched and the cosine computed in double precision, so nothing below the threshold is linked.

Candidates share a band of signs under further rotations: K bits a band, K growing with the logarithm of the number of
vectors, and as many bands as give a pair at the threshold the chance RECALL to meet (closer pairs have a higher chance).
So a link is lost with a chance of 1 - RECALL at most; the README has the measured share. Components are found by
links.py. All links lie within a component; there blocks of at most BLOCK vectors are judged pair by pair in matrices, by
codes first, so that links are counted without being written out. The blocks of a component are spread over tasks.

Defined cases: equal vectors are one class first, their rows link with each other; null, zero or non-finite vectors, and
null components, link with nothing; vectors of other dimensions only link among their own; rows with equal or null vec_id
all stay; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, with_group
from .links import link_components

THRESHOLD, RECALL, ERRORS, CODE_BITS, BLOCK = 0.9, 0.9999, 5.0, 256, 1024
#: Levels of the four-bit form on either side of zero, and pairs that are judged at a time.
LEVELS, PAIRS = 7, 1 << 16


@lru_cache(maxsize=8)
def rotations(dim: int, bits: int, seed: int) -> np.ndarray:
    """[dim, bits]: random orthogonal bases side by side, the same for every worker."""
    r = np.random.default_rng((seed, dim))
    blocks = [np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]
    return np.concatenate(blocks, axis=1)[:, :bits]


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # against overflow and underflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, steps, factors) of unit vectors, padded to CODE_BITS dimensions at least: a byte for each two dimensions,
    four bits of sign and size each."""
    dim = max(CODE_BITS, x.shape[1])
    dim += dim & 1
    turned = x @ rotations(dim, dim, 7)[: x.shape[1]]
    steps = np.abs(turned).max(axis=1) / (LEVELS + 0.5)
    size = np.minimum(np.abs(turned) / steps[:, None], LEVELS).astype(np.uint8)
    nibbles = size | (turned < 0).astype(np.uint8) << 3
    return nibbles[:, ::2] << 4 | nibbles[:, 1::2], steps, np.abs(turned).sum(axis=1) / math.sqrt(dim)


_SIGNS = np.where(np.arange(16) < 8, 1.0, -1.0).astype(np.float32)
_SIZES = (_SIGNS * (np.arange(16) % 8 + 0.5)).astype(np.float32)  # the middle of each level


def opened(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs, four-bit forms in steps) of codes."""
    nibbles = np.empty((code.shape[0], code.shape[1] * 2), np.uint8)
    nibbles[:, ::2], nibbles[:, 1::2] = code >> 4, code & 15
    return _SIGNS[nibbles], _SIZES[nibbles]


def error(factors: np.ndarray, steps: np.ndarray, dim: int) -> np.ndarray:
    """The bound of an estimate by signs with these factors and forms with these steps."""
    return ERRORS * np.sqrt((1 - factors**2) / (factors**2 * (dim - 1)) + steps**2 / (12 * factors**2))


def may_link(p, q, threshold: float) -> np.ndarray:
    """Whether the cosine of each pair may reach the threshold. p, q: (codes, steps, factors) of the pairs' ends."""
    (cp, sp, fp), (cq, sq, fq) = p, q
    out = np.zeros(len(sp), bool)
    for a in range(0, len(sp), PAIRS):
        s = slice(a, a + PAIRS)
        (xp, yp), (xq, yq) = opened(cp[s]), opened(cq[s])
        dim = xp.shape[1]
        one = np.einsum("ij,ij->i", xp, yq) * sq[s] / math.sqrt(dim) / fp[s] + error(fp[s], sq[s], dim)
        two = np.einsum("ij,ij->i", xq, yp) * sp[s] / math.sqrt(dim) / fq[s] + error(fq[s], sp[s], dim)
        out[s] = np.minimum(one, two) >= threshold
    return out


def links_between(p, q, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """[x, y] whether the cosine of two unit vectors reaches the threshold: by codes first, in double precision for the
    rows and columns that they leave open."""
    (cp, sp, fp), (cq, sq, fq) = p, q
    (xp, yp), (xq, yq) = opened(cp), opened(cq)
    dim = xp.shape[1]
    root = math.sqrt(dim)
    some = (xp @ yq.T) * sq / root / fp[:, None] + error(fp[:, None], sq, dim) >= threshold
    some &= (yp @ xq.T) * sp[:, None] / root / fq + error(fq, sp[:, None], dim) >= threshold
    i, j = np.flatnonzero(some.any(1)), np.flatnonzero(some.any(0))
    if len(i):
        some[np.ix_(i, j)] &= x[i] @ y[j].T >= threshold
    return some


def bands_for(n: int, threshold: float) -> tuple[int, int]:
    """(bits a band, bands) for n vectors."""
    k = max(8, math.ceil(math.log2(max(2, n))) + 2)
    same = (1 - math.acos(threshold) / math.pi) ** k
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bytes(column: pa.Array) -> np.ndarray:
    """[row, byte] of binary values of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _lengths(column: pa.Array) -> np.ndarray:
    count = pc.binary_length if pa.types.is_binary(column.type) else pc.list_value_length
    return count(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _by_size(column: pa.Array):
    """(length, rows) of the values of each length."""
    sizes = _lengths(column)
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        yield int(n), own, column.take(pa.array(own))


def _digests(batches):
    for b in batches:
        found = [None if v is None else hashlib.blake2b(np.asarray(v, np.float64).tobytes(), digest_size=16).digest() for v in b.column("embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), b.column("at"), b.column("embedding"), pa.array(found, pa.binary())], ["vec_id", "at", "embedding", "digest"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    clean = vectors.select("vec_id", F.monotonically_increasing_id().alias("at"), F.when(finite, F.transform(e, lambda x: x.cast("double") + F.lit(0.0))).alias("embedding"))
    rows = cut(clean.mapInArrow(_digests, "vec_id long, at long, embedding array<double>, digest binary"))
    slim = cut(rows.select("vec_id", "at", "digest"))
    # copies are counted in parts of a digest's rows first, so a common vector needn't come to one task
    salted = rows.where("digest is not null").withColumn("_s", F.pmod(F.xxhash64("at"), F.lit(64)))
    parts = salted.groupBy("digest", "_s").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    classes = parts.groupBy("digest").agg(F.min("least").alias("least"), F.sum("copies").alias("copies"), F.any_value("embedding").alias("embedding"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "digest", "least", "copies", "embedding"))
    discard(rows)
    n = classes.count()
    k, bands = bands_for(n, threshold)

    def encode(batches):
        for b in batches:
            for _, own, column in _by_size(b.column("embedding")):
                code, steps, factors = codes(unit(_matrix(column)))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(own)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(steps), pa.array(factors)], ["id", "code", "step", "factor"])

    coded = cut(classes.select("id", "embedding").mapInArrow(encode, "id long, code binary, step double, factor double"))

    def post(batches):
        weights = (np.uint64(1) << np.arange(k, dtype=np.uint64)).astype(np.float64)
        for b in batches:
            ids = b.column("id").to_numpy()
            for dim, own, column in _by_size(b.column("embedding")):
                x = unit(_matrix(column))
                key = np.empty((len(own), bands), np.int64)
                turn = rotations(dim, k * bands, 11)
                for a in range(bands):
                    key[:, a] = ((x @ turn[:, a * k : (a + 1) * k] >= 0) @ weights).astype(np.int64) + (a << k) + (dim << 50)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.repeat(ids[own], bands))], ["key", "id"])

    posted = cut(classes.select("id", "embedding").mapInArrow(post, "key long, id long"))
    twice = posted.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    postings = cut(posted.join(twice, "key"))
    discard(posted)

    def screen(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            sizes = np.where(_lengths(b.column("ca")) == _lengths(b.column("cb")), _lengths(b.column("ca")), 0)
            for size in np.unique(sizes[sizes > 0]):
                own = pa.array(np.flatnonzero(sizes == size))
                p, q = ((_bytes(b.column(f"c{s}").take(own)), b.column(f"s{s}").take(own).to_numpy(), b.column(f"f{s}").take(own).to_numpy()) for s in "ab")
                keep[own.to_numpy()] = may_link(p, q, threshold)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    def exact(batches):
        for b in batches:
            x, y = b.column("x"), b.column("y")
            keep = np.zeros(b.num_rows, bool)
            for n, own, _ in _by_size(x):
                same = own[_lengths(y)[own] == n]
                if len(same):
                    p, q = (unit(_matrix(c.take(pa.array(same)))) for c in (x, y))
                    keep[same] = np.einsum("ij,ij->i", p, q) >= threshold
            yield b.select(["a", "b"]).filter(pa.array(keep))

    def verify(pairs: DataFrame) -> DataFrame:
        ends = [coded.select(F.col("id").alias(s), F.col("code").alias(f"c{s}"), F.col("step").alias(f"s{s}"), F.col("factor").alias(f"f{s}")) for s in "ab"]
        open_pairs = cut(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "ca", "sa", "fa", "cb", "sb", "fb").mapInArrow(screen, "a long, b long"))
        full = open_pairs.join(classes.select(F.col("id").alias("a"), F.col("embedding").alias("x")), "a").join(classes.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")
        linked = cut(full.select("a", "b", "x", "y").mapInArrow(exact, "a long, b long"))
        discard(open_pairs)
        return linked

    comps = link_components(postings, verify)
    discard(postings)
    named = classes.select("id", "digest", "least", "copies").join(comps, "id", "left").withColumn("c", F.coalesce("c", "id"))
    facts = {"component_id": F.min("least"), "members": F.count("*")}
    named = cut(with_group(named, ["c"], ["id"], facts, {"component_id": F.min("component_id"), "members": F.sum("members")}))

    # every pair of a component's blocks, the upper triangle: a row goes to as many pairs as there are blocks
    several = named.filter("members > 1").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    data = classes.select("id", "embedding").join(coded, "id")
    dealt = several.select("c", "id", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).join(data, "id")
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    tasks = several.agg(F.count("*")).first()[0] // BLOCK + 1
    parallel = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        # blocks of one pair; small components are one block each
        x, copies = unit(np.stack(pdf["embedding"].to_numpy())), pdf["copies"].to_numpy()
        p = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1), pdf["step"].to_numpy(), pdf["factor"].to_numpy()
        a = np.flatnonzero(pdf["block"].to_numpy() == pdf["lo"].iloc[0])
        if pdf["lo"].iloc[0] == pdf["hi"].iloc[0]:
            near = links_between(p, p, x, x, threshold)
            near |= near.T
            np.fill_diagonal(near, False)
            return pd.DataFrame({"id": pdf["id"], "near": near @ copies})
        b = np.flatnonzero(pdf["block"].to_numpy() == pdf["hi"].iloc[0])
        near = links_between(tuple(v[a] for v in p), tuple(v[b] for v in p), x[a], x[b], threshold)
        return pd.DataFrame({"id": pdf["id"].to_numpy()[np.concatenate([a, b])], "near": np.concatenate([near @ copies[b], near.T @ copies[a]])})

    # a fixed number of partitions: the few large pairs of blocks of a hot component aren't put into one task
    dealt = dealt.repartition(max(parallel, min(4 * parallel, tasks)), "c", "lo", "hi")
    near = dealt.groupBy("c", "lo", "hi").applyInPandas(count, "id long, near long").groupBy("id").agg(F.sum("near").alias("near"))
    found = cut(named.join(near, "id", "left").select("digest", "component_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")))
    # the rows of a common vector are dealt over parts, which have its result each
    salted = slim.withColumn("_salt", F.pmod(F.xxhash64("at"), F.lit(256)))
    keys = salted.where("digest is not null").select("digest", "_salt").distinct().join(found, "digest")
    out = salted.join(keys, ["digest", "_salt"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS v, vec_id AS u FROM embeddings UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN c ON c.v = vec_id LEFT JOIN n ON n.a = vec_id
"""
