"""Exact dedup, spelling variants and hard negatives against brute force."""

import hashlib
import random
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, golomb, pivots, spelling
from quillspark.llm.wavelet import WaveletTree


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(0, 2**40), min_size=1, max_size=300), st.integers(0, 38))
def test_golomb_round_trip(values, extra):
    x = np.array(sorted(values), np.uint64)
    k = max(golomb.best_k(2**40, len(x)), extra)
    assert (golomb.decode(golomb.encode(x, k), len(x), k) == x).all()


def test_golomb_codes_are_short():
    x = np.unique(np.random.default_rng(1).integers(0, 2**30, 1000)).astype(np.uint64)
    assert len(golomb.encode(x, golomb.best_k(2**30, len(x)))) * 8 < 23 * len(x)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=80), st.lists(st.tuples(*[st.integers(0, 80)] * 4), min_size=1, max_size=10))
def test_wavelet_tree_reports_what_a_scan_finds(values, asked):
    v = np.array(values)
    a, b, c, d = np.array(asked).T
    a, b = np.minimum(a, len(v)), np.minimum(b, len(v))
    q, found = WaveletTree(v).report(a, b, c, d)
    got = sorted(zip(q.tolist(), found.tolist(), strict=True))
    assert got == sorted((i, int(x)) for i in range(len(a)) for x in v[a[i] : b[i]] if c[i] <= x < d[i])


def dedup_by_hand(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = Counter()
    for text, docs in groups.items():
        keep = max((d for d in docs if d is not None), default=None)
        for k, d in enumerate(sorted(docs, key=lambda d: (d is not None, d or 0), reverse=True)):
            out[d, keep, len(docs), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def deduped(df, **kw):
    return Counter(map(tuple, exact_dedup.dedup(df, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def dedup_rows():
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", "", None, "long " * 5000, f"only {i}"])) for i in range(400)]
    return rows + [(7, "a"), (7, "a"), (None, "a"), (None, None), (None, "nulls alone"), (None, "nulls alone"), (9, "é"), (10, "é")]


@pytest.mark.parametrize("slack", [exact_dedup.SLACK, -1])
def test_dedup_of_ties_nulls_repeats_and_colliding_fingerprints(spark, monkeypatch, slack):
    monkeypatch.setattr(exact_dedup, "SLACK", slack)
    rows = dedup_rows()
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, file int, row int, _metadata int").repartition(7)
    assert deduped(df) == dedup_by_hand(rows)


def test_dedup_in_waves_of_files_and_of_derived_tables(spark, tmp_path):
    rows = dedup_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(6).write.parquet(str(tmp_path / "d"))
    files = spark.read.parquet(str(tmp_path / "d"))
    assert deduped(files, wave_bitmaps=1) == dedup_by_hand(rows)
    assert deduped(files.where("doc_id > 100")) == dedup_by_hand([x for x in rows if x[0] is not None and x[0] > 100])
    twice = files.select("doc_id", F.explode(F.array("text", "text")).alias("text"))
    assert deduped(twice) == dedup_by_hand(rows * 2)


def test_dedup_of_no_rows(spark):
    assert not deduped(spark.createDataFrame([], "doc_id long, text string"))


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(n: dict[str, int]) -> set:
    found = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: v for w, vs in found.items() if vs and n[v := min(vs, key=lambda v: (-n[v], v))] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(found[w]), n.get(form.get(w))) for w in n}


@pytest.mark.parametrize("shard_words", [2, 40, 1 << 15])
def test_variants_of_words_over_few_letters(spark, shard_words):
    import zlib

    r = random.Random(shard_words)
    words = ["".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(150)] + ["a" * 7, "a" * 8, "a" * 9, "b" * 300, "b" * 299, "b" * 150 + "c" + "b" * 149, "shared" + "x" * 9]
    words += ["shared" + "x" * i + "y" + "x" * (8 - i) for i in range(9)]
    texts = [(i, " ".join(r.choice(words).upper() if r.random() < 0.1 else r.choice(words[:: 1 + i % 9]) for _ in range(60)) + " x1y×y " + "-".join(words[:3])) for i in range(60)]
    texts += [(60, " ".join(["abababa"] * 400 + ["abababb"] * 30 + ["ababbbb"] * 3)), (61, None), (62, ""), (None, "abababa Abababa"), (60, "abababa")]
    n = Counter()
    for doc, text in texts:
        for letter, run in groupby(text or "", lambda c: c.isascii() and c.isalpha() or "À" <= c <= "ÿ"):
            if letter:
                w = "".join(c.lower() if c.isascii() else c for c in run)
                h = zlib.crc32(f"{'null' if doc is None else doc}:{w}".encode())
                if h % 31 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}
    df = spark.createDataFrame([(*x, 1, 2) for x in texts], "doc_id long, text string, word int, n int")
    got = spelling.variants(df, shard_words=shard_words).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(n) and set(map(tuple, got)) == variants_by_hand(n)


def test_variants_of_no_rows_and_forms_of_forms(spark):
    assert not spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect()
    steps = {f"w{i}": f"w{i + 1}" for i in range(9)}
    got = spelling.roots(spark.createDataFrame(list(steps.items()), "word string, form string")).collect()
    assert {tuple(x) for x in got} == {(w, "w9") for w in steps}


def mined_by_hand(rows, anchor, positives=5, negatives=10):
    import math

    v = [(at, i, label, [math.floor(256 * x) for x in e]) for at, (i, e, label) in enumerate(rows) if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for at, i, label, e in v:
        if not anchor(i):
            continue
        s = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), j, at2, other) for at2, j, other, f in v if at2 != at and len(f) == len(e))
        for p, j, _, _ in [x for x in s if x[3] == label][:positives]:
            fit = [x for x in s if x[3] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives]
            for rank, (score, k, _, _) in enumerate(fit, 1):
                out[i, j, rank, k, -p, -score] += 1
    return out


@pytest.mark.parametrize("block", [8, 1024])
def test_hard_negatives_of_ties_nulls_lengths_and_a_hot_label(spark, block):
    r = np.random.default_rng(block)
    rows = []
    for i in range(260):
        x = (r.normal(size=6) * 3).round(1)
        rows.append((i, (x if i % 11 else x[:4]).tolist(), 0 if i % 3 else int(r.integers(0, 4))))
    rows += [(30, rows[30][1], 0), (30, rows[30][1], 1), (None, [1.0] * 6, 1), (301, None, 1), (302, [], 1), (303, [float("nan")] * 6, 1), (304, [None] * 6, 1), (305, [float("inf")] * 6, 1), (306, [1.0] * 6, None), (310, [0.0] * 6, 2), (320, [5e6] * 6, 1), (330, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "vec_id long, embedding array<double>, label int, at int, dim string").repartition(5)
    got = pivots.hard_negatives(df, F.col("vec_id") % 10 == 0, block=block, seeds=1)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == mined_by_hand(rows, lambda i: i % 10 == 0)


def test_brackets_hold_every_score_and_tell_clusters_apart():
    r = np.random.default_rng(2)
    x = np.floor(256 * (np.repeat(r.normal(size=(4, 16)) * 4, 50, axis=0) + r.normal(size=(200, 16)) * 0.1))
    most = (x * x).sum(axis=1).max() * (1 + 1e-12) + 1
    p = pivots.farthest_first(pivots.augmented(x, most), 8)

    def side(rows, dists):
        s = pivots._Side.__new__(pivots._Side)
        s.n, s.dim, s.norms, s.vectors, s.dists = len(rows), 16, (rows * rows).sum(axis=1), rows, dists
        return s

    far = lambda a: np.linalg.norm(a[:, None] - p[None], axis=2)
    q, y = side(x[::10], far(np.concatenate([x[::10], np.zeros((20, 1))], axis=1))), side(x, far(pivots.augmented(x, most)))
    worst, best = pivots.brackets(q, y, most)
    exact = x[::10] @ x.T
    assert (worst <= exact).all() and (exact <= best).all()
    assert (best < np.sort(exact, axis=1)[:, [-50]]).mean() > 0.2  # pairs that the pivots alone rule out


def test_hard_negatives_of_no_rows(spark):
    assert not pivots.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 10 == 0).collect()
