"""N-gram Jaccard join with multiple-global-order prefix filters.

Each text becomes the set of its distinct word shingles; equal sets become one class first. Under any order of all
shingles, two sets that reach the similarity share one of the first n - ceil(t n) + 1 of each. Three orders are used,
all with rare shingles first (by the sum of a count sketch over all documents, exact and coarse, and different hashes):
shared prefix shingles under the first order give candidates; those that share none under the second or the third are
dropped; the rest are verified on their whole sets. Components come from links.py, so groups of near copies aren't
expanded into pairs, and no link between different components is lost.

Defined cases: a text with fewer words than a shingle has its whole sequence as its one shingle; null text or text
without words has an empty set and links with nothing; rows with equal doc_id are all kept and linked by their texts;
an empty table gives an empty result; columns other than doc_id and text are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, batches_of, cut, discard
from .links import link_components
from .shingles import mix, shingle_sets
from .tokens import release, slices

#: The sketch: rows of so many counters. Its size is fixed, so it may be sent to every task.
SKETCH_BITS, SKETCH_ROWS, SLICES = 20, 2, 64
#: Bits of the map of wanted documents that every task gets: 4 MB at any size of the corpus.
WANTED_BITS = 25
#: Bytes of text that a worker hashes at a time.
SLICE = 1_000_000
#: Rows of an Arrow batch.
ROWS = 1000
_SEED = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _slots(tokens: np.ndarray, row: int) -> np.ndarray:
    return (mix(tokens ^ _SEED[row]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of all distinct shingles of all documents, by hash. Each partition sends its counters in SLICES parts,
    which are summed part by part as they stream in."""

    def count(batches):
        sums = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.uint32)
        for b in slices(batches, "text", SLICE):
            tokens = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(b.column("text"), size)])
            for r in range(SKETCH_ROWS):
                sums[r] += np.bincount(_slots(tokens, r), minlength=1 << SKETCH_BITS).astype(np.uint32)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array([x.tobytes() for x in np.split(sums.reshape(-1), SLICES)], pa.binary())], ["part", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
                c = np.frombuffer(x.as_buffer(), np.uint32)
                sums[k] = sums[k] + c if k in sums else c.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    parts = docs.select("text").mapInArrow(count, "part long, counts binary").repartition(SLICES, "part").mapInArrow(add, "part long, counts binary").collect()
    out = np.zeros((SLICES, SKETCH_ROWS * (1 << SKETCH_BITS) // SLICES), np.uint32)
    for x in parts:
        out[x["part"]] = np.frombuffer(x["counts"], np.uint32)
    return out.reshape(SKETCH_ROWS, -1)


def _prefixes(tokens: np.ndarray, counts: np.ndarray, length: int) -> list[np.ndarray]:
    """The first tokens under each of the three orders. Coarser classes of the count, and other hashes, make the orders
    differ; a token's rank depends on the token and the sketch alone."""
    kinds = counts.astype(np.uint64), np.log2(counts.astype(np.float64) + 1).astype(np.uint64), (np.log2(counts.astype(np.float64) + 1) / 2).astype(np.uint64)
    out = []
    for k, seed in zip(kinds, _SEED, strict=True):
        rank = (np.minimum(k, np.uint64(0xFFFFFF)) << np.uint64(40)) | (mix(tokens * seed) >> np.uint64(24))
        first = np.argpartition(rank, length - 1)[:length] if length < len(rank) else np.arange(len(rank))
        out.append(tokens[first[np.argsort(rank[first], kind="stable")]])
    return out


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))


def signatures(docs: DataFrame, size: int, percent: int, counts, mark: Column | None = None) -> DataFrame:
    """doc_id, n (shingles), digest of the set, the prefixes under each order, of sets that may have a link to another
    set, and mark (binary) of the row. counts: a broadcast sketch."""
    least = -(-percent // (100 - percent))  # a smaller set can only link with itself

    def run(batches):
        table, none = counts.value, np.zeros(0, np.int64)
        for b in slices(batches, "text", SLICE):
            n, digest, first = [], [], [[], [], []]
            for tokens in shingle_sets(b.column("text"), size):
                n.append(len(tokens))
                digest.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                p = [none, none.view(np.int32), none.view(np.int32)]
                if len(tokens) >= least:
                    seen = np.minimum(*(table[r][_slots(tokens, r)] for r in range(SKETCH_ROWS)))
                    length = len(tokens) - -(-percent * len(tokens) // 100) + 1
                    p = _prefixes(tokens, seen, length)
                    p = [p[0].view(np.int64), *((x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in p[1:])]
                for k in range(3):
                    first[k].append(p[k])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *map(_lists, first), b.column("mark")],
                ["doc_id", "n", "digest", "p1", "p2", "p3", "mark"],
            )

    marked = (F.lit(None) if mark is None else mark).cast("binary").alias("mark")
    return docs.select("doc_id", "text", marked).mapInArrow(run, "doc_id long, n long, digest binary, p1 array<long>, p2 array<int>, p3 array<int>, mark binary")


def _bit(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << WANTED_BITS))


def _wanted(reps: DataFrame) -> np.ndarray:
    """A map with a bit set for each of reps (least), by hash, so that other documents' texts stay where they are."""
    rows = reps.select(_bit(F.col("least")).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros((1 + (1 << WANTED_BITS) // 32768, 4096), np.uint8)
    for r in rows:
        out[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _sets(docs: DataFrame, size: int, reps: DataFrame) -> DataFrame:
    """digest and tokens of the texts of reps, and of the few others that share a bit with one of them."""
    wanted = docs.sparkSession.sparkContext.broadcast(_wanted(reps))

    def run(batches):
        bits = wanted.value
        for b in slices(batches, "text", SLICE):
            at = b.column("at").to_numpy()
            b = b.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            if not b.num_rows:
                continue
            sets = shingle_sets(b.column("text"), size)
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "tokens"])

    # bucket numbers start at 1 for the hashes from 1 on; hash 0 is bucket 0's only one
    at = (F.bitmap_bucket_number("h") * 32768 + F.bitmap_bit_position("h")).alias("at")
    return docs.select("text", _bit(F.col("doc_id")).alias("h")).select("text", at).mapInArrow(run, "digest binary, tokens binary")


def _verified(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = (np.frombuffer(c.as_buffer(), np.uint64) for c in (x, y))
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    return run


def _components(docs: DataFrame, size: int, percent: int, mark: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (digest, c, least) of all sets: c numbers the component, least is the smallest
    doc_id with the set."""
    spark = docs.sparkSession
    batches_of(spark, ROWS)
    counts = spark.sparkContext.broadcast(sketch(docs, size))
    rows = cut(signatures(docs, size, percent, counts, mark))
    classes = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min_by(F.struct("n", "p1", "p2", "p3"), F.coalesce("doc_id", F.lit(0))).alias("s"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "digest", "least", "s.*"))
    # of the rows' signatures only these are needed from here on; the prefixes are kept once, by class
    kept = cut(rows.select("doc_id", "n", "digest", "mark"))
    discard(rows)
    rows = kept
    posted = classes.select("id", "n", F.posexplode("p1").alias("pos", "key"))
    twice = posted.groupBy("key").agg(F.count("*").alias("_k")).filter("_k > 1").select("key")
    postings = cut(posted.join(twice, "key").select("key", "id", "n", "pos"))

    def may_link(x: str, y: str):
        """Sizes allow it, and the token lies where the first shared one of two linked sets must: what follows it in
        either set, with itself, is the whole overlap. So no other shared token needs a row."""
        nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
        return (100 * nx >= percent * ny) & (100 * ny >= percent * nx) & ((100 + percent) * F.least(nx - px, ny - py) >= percent * (nx + ny))

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (classes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("p2").alias(f"p2{k}"), F.col("p3").alias(f"p3{k}"), F.col("digest").alias(f"d{k}")) for k in "ab")
        left = pairs.join(a, "a").join(b, "b").filter(F.arrays_overlap("p2a", "p2b") & F.arrays_overlap("p3a", "p3b")).select("a", "b", "da", "db")
        left = cut(left)
        needed = left.select(F.col("da").alias("digest")).union(left.select("db")).distinct()
        reps = classes.join(needed, "digest").select("least")
        sets = cut(_sets(docs, size, reps).dropDuplicates(["digest"]), codec="none")
        full = left.join(sets.select(F.col("digest").alias("da"), F.col("tokens").alias("x")), "da").join(sets.select(F.col("digest").alias("db"), F.col("tokens").alias("y")), "db")
        linked = cut(full.select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long"))
        discard(left, sets)
        return linked

    comps = link_components(postings, verify, may_link, central=F.col("pos"))
    return rows, classes.join(comps, "id", "left").select("digest", F.coalesce("c", "id").alias("c"), "least")


def join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, found = _components(docs, size, percent)
    smallest = found.groupBy("c").agg(F.min("least").alias("component_id"))
    named = found.join(smallest, "c").select("digest", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """One row of each component, with all columns: that of its smallest doc_id (null comes last), then of the smallest
    digest of doc_id and text, then of the smallest hash of the row. Rows are linked by their texts alone: equal or null
    doc_id with unlinked texts are all kept, and so is every row without words. Other columns may have any name and type."""
    mark = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))))
    blank = F.coalesce(~F.col("text").rlike(WORD), F.lit(True))
    rows, found = _components(docs, size, percent, mark)
    first = rows.join(found, "digest").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("_s"))
    first = first.select(F.col("_s.mark").alias("mark"))
    # the row is one column, so that no name of its own can clash
    own = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.filter(~blank).select(F.struct(*own).alias("row"), mark.alias("mark"), _row_hash(docs).alias("turn")).join(first, "mark", "left_semi")
    one = kept.groupBy("mark").agg(F.min_by("row", "turn").alias("row"))
    return one.select("row.*").union(docs.filter(blank))


def _row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row; types that can't be hashed, such as maps, by their JSON."""
    odd = [f.name for f in docs.schema if any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if c in odd else F.col(f"`{c}`") for c in docs.columns))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.k = b.k AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(u) FROM r WHERE r.v = s.doc_id) AS component_id FROM s
"""
