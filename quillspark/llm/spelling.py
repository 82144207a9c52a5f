"""Spelling variants by two-dimensional range reporting.

Words are counted in Spark. Two words are near if one edit turns one into the other: a code point replaced, or inserted into
the shorter. An edit at position i leaves the code points before and after it alone, so near words share a prefix and a
suffix. Words of one length stand in forward order and in order of their reversed forms; words with a prefix are an interval
of the first, words with a suffix one of the second, and a wavelet tree over both ranks reports the words in both. It is
asked for every word and edit position at which a word of the shard can first differ, which the longest common prefixes of
neighbours in order tell. An inserted code point among equal ones is reported at the last of its positions alone, so each
pair comes once.

Shards: an edit lies in the first or the second half of a word, the other half is intact. So a word is posted by its intact
half, once for each half, as one of its own length and as one that lacks a code point. Halves that one word has alone go no
further. Halves of more than SHARD_WORDS words are posted again by each half of the half, until shards are small; a shard
whose words differ in one position is as large as the alphabet at most. Shards are dealt to tasks of about TASK_CHARS.

Defined cases: null texts have no words; a null doc_id counts as the text "null" in the hash of an occurrence; rows that
repeat count as often as they come; words of any length are compared whole; an empty table gives an empty result; other
columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .wavelet import WaveletTree

#: fixed values: letters of a word, of which code points 00C0 to 00FF; the smallest length and count; the share of a form
LETTERS = "A-Za-z\\u00C0-\\u00FF"
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO, DROPPED = 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_WORDS, TASK_CHARS = 1 << 15, 1 << 19


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, dropped: int = DROPPED) -> DataFrame:
    """word and n. Of occurrences whose hash dropped divides, the code point that the hash points at is left out."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select(F.translate("run", UPPER, LOWER).alias("run"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = F.pmod(h, F.length("run")).cast("int")
    word = F.when(F.pmod(h, F.lit(dropped)) == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _posted(words: DataFrame, segments: Column) -> DataFrame:
    """A row for each of segments, structs of whole (whether the word has the shard's length, else one less), size (that
    length), lo and hi (the edit lies in [lo, hi)). group numbers the rows with the same size, segment and intact parts."""
    p = words.select("word", "n", F.explode(segments).alias("s")).select("word", "n", "s.*")
    after = F.substring("word", F.col("hi") + F.col("whole").cast("int"), F.length("word"))
    return p.withColumn("group", F.xxhash64("size", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), after))


def _segment(whole: bool, size: Column, lo: Column, hi: Column) -> Column:
    return F.struct(F.lit(whole).alias("whole"), size.cast("int").alias("size"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _halves(whole: bool, size: Column, lo: Column, hi: Column) -> list[Column]:
    middle = F.floor((lo + hi) / 2)
    return [_segment(whole, size, lo, middle), _segment(whole, size, middle, hi)]


def _shared(rows: DataFrame) -> DataFrame:
    """Groups in which two words may be near, with their sizes; 0 where the edit has one position, as those stay whole."""
    return cut(rows.groupBy("group").agg(F.count("*").alias("words"), F.max("whole").alias("any"), F.any_value(F.col("hi") - F.col("lo")).alias("wide")).where("words > 1 and any").select("group", F.when(F.col("wide") > 1, F.col("words")).otherwise(0).alias("words")))


def sharded(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of all shards: word, n, whole, size, lo, hi and group."""
    size = F.length("word")
    rows = cut(_posted(words, F.array(*(s for whole in (True, False) for s in _halves(whole, size + int(not whole), F.lit(0), size + int(not whole))))))
    done = []
    while True:
        groups = _shared(rows)
        large = groups.where(F.col("words") > shard_words).select("group")
        many = large.count()
        done.append(rows.join(groups.where(F.col("words") <= shard_words).select("group"), "group"))
        if not many:
            break
        hot = rows.join(F.broadcast(large) if many < 10_000 else large, "group").select("word", "n", F.struct("whole", "size", "lo", "hi").alias("o"))
        o = [F.col(f"o.{c}") for c in ("size", "lo", "hi")]
        rows = cut(_posted(hot, F.when(F.col("o.whole"), F.array(*_halves(True, *o))).otherwise(F.array(*_halves(False, *o)))))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return cut(out)


def _matrix(words: list[bytes], size: int) -> np.ndarray:
    return np.array(words, f"S{size}").view(np.uint8).reshape(len(words), size)


def _heads(m: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(m[:, :size]).view(f"S{size}").reshape(-1)


def _interval(ordered: np.ndarray, asked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in ordered rows those lie that begin as the asked ones do, by size characters."""
    if not size:
        return np.zeros(len(asked), np.int64), np.full(len(asked), len(ordered))
    every, mine = _heads(ordered, size), _heads(asked, size)
    return np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")


def near_pairs(whole: list[bytes], short: list[bytes], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """whole: distinct words of one length, short: of one less. (w, v) of every two of whole that differ by one replaced
    character at a position in [lo, hi), both ways, and (s, v) of every one of short that one character inserted there
    turns into one of whole."""
    size, m, k = len(whole[0]), len(whole), len(short)
    full = _matrix(whole, size)
    turned = np.ascontiguousarray(full[:, ::-1])
    forward, reverse = np.argsort(_heads(full, size)), np.argsort(_heads(turned, size))
    rank = np.empty(m, np.int64)
    rank[reverse] = np.arange(m)
    tree = WaveletTree(rank[forward])
    lack = _matrix(short, size - 1) if k else np.zeros((0, size - 1), np.uint8)
    both = np.concatenate([full, np.pad(lack, ((0, 0), (0, 1)))])
    both = both[np.argsort(_heads(both, size))]
    differ = both[1:] != both[:-1]
    firsts = np.unique(differ.argmax(axis=1)) if len(differ) else np.zeros(0, int)
    found = [[], [], [], []]
    for p in firsts[(firsts >= lo) & (firsts < hi)]:
        rest = size - 1 - int(p)
        for asked, at in ((full, 0), (lack, 2)):
            if not len(asked):
                continue
            backward = asked[:, ::-1]
            q, v = tree.report(*_interval(full[forward], asked, int(p)), *_interval(turned[reverse], backward, rest))
            v = reverse[v]
            same = q == v if at == 0 else (lack[q, p] == full[v, p] if p < size - 1 else np.zeros(len(q), bool))
            found[at].append(q[~same])
            found[at + 1].append(v[~same])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _near(rows: pa.Table) -> pa.Table:
    """The shards of one task -> word, near and near_n, both ways."""
    words = np.array([w.encode("latin-1") for w in rows.column("word").to_pylist()], object)
    n = rows.column("n").to_numpy()
    whole = rows.column("whole").to_numpy()
    kinds = np.stack([rows.column(c).to_numpy() for c in ("size", "lo", "hi")], axis=1)
    order = np.lexsort(kinds.T)
    ends = np.flatnonzero(np.any(np.diff(kinds[order], axis=0), axis=1)) + 1
    left, right = [], []
    for own in np.split(order, ends):
        full, short = own[whole[own]], own[~whole[own]]
        if len(full):
            w, v, s, t = near_pairs(list(words[full]), list(words[short]), int(kinds[own[0], 1]), int(kinds[own[0], 2]))
            left += [full[w], short[s], full[t]]
            right += [full[v], full[t], short[s]]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    text = pa.array([w.decode("latin-1") for w in words], pa.string())
    return pa.table({"word": text.take(pa.array(a)), "near": text.take(pa.array(b)), "near_n": pa.array(n[b])})


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, task_chars: int = TASK_CHARS) -> DataFrame:
    """word, near and near_n of every two near words, both ways. words: word and n, distinct."""
    rows = sharded(words, shard_words)
    chars = rows.agg(F.sum(F.length("word"))).first()[0] or 0
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // task_chars + 1)
    dealt = rows.withColumn("task", F.pmod("group", F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms of forms are looked up until there are none, twice as far in each round. A
    form is more frequent than its word, so no chain comes back."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = new
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, form_ratio: int = FORM_RATIO, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word. Its form is the near word that is the most frequent (ties:
    the first in order of code points), if that has form_ratio times its count at least; its root the last of the forms
    from word to word, itself if it has none."""
    words = cut(vocabulary(docs))
    pairs = near_words(words, shard_words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    is_form = -F.col("b.m") >= form_ratio * F.col("n")
    formed = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("b.near")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n")))
    found = roots(formed.where("form is not null"))
    return formed.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS t),
o AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc, run, count(*) AS k, hex(doc || ':' || run) AS x FROM o GROUP BY doc, run),
c AS (SELECT run, k, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t.t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM d, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, k FROM c),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE len(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
p AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v),
q AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM p),
e AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM q x JOIN q y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT v.word, q.word, q.n FROM q JOIN v ON v.word = q.a || q.b
  UNION SELECT q.word, v.word, v.n FROM q JOIN v ON v.word = q.a || q.b),
m AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN m ON m.word = v.word),
r AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT r.word, f.form, r.step + 1 FROM r JOIN f ON f.word = r.root AND f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT last(root ORDER BY step) FROM r WHERE r.word = f.word) AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f
"""
