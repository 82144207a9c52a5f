"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from quillspark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, code string, c long"


def brute(ids, rows, threshold=0.9):
    """(links, component) of each row by all pairs, in double precision; ids as given."""
    n = len(rows)
    label, links = list(range(n)), [0] * n
    good = [r is not None and all(x is not None and np.isfinite(x) for x in r) and any(r) for r in rows]
    x = [np.array(r, np.float32).astype(float) if g else None for r, g in zip(rows, good, strict=True)]
    x = [v / np.sqrt((v * v).sum()) if v is not None else None for v in x]

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold:
                links[i] += 1
                links[j] += 1
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(links[i], least.get(find(i)) if good[i] else ids[i]) for i in range(n)]


def compare(spark, ids, rows):
    data = [(i, None if r is None else [None if v is None else float(v) for v in r], "x", 1) for i, r in zip(ids, rows, strict=True)]
    out = vectors.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    want = brute(ids, rows)
    key = lambda x: repr(x)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in out], key=key) == sorted([(i, *w) for i, w in zip(ids, want, strict=True)], key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return out


def planted(rng, pairs, dim, low=0.9, high=0.93):
    """Pairs with cosines between low and high, and as many vectors alone."""
    x = rng.standard_normal((pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, dim))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(low, high, (pairs, 1))
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * y])


@pytest.mark.parametrize("dim", [64, 300])
def test_planted_pairs_are_all_found(spark, dim):
    rows = planted(np.random.default_rng(3), 500, dim)
    compare(spark, list(range(len(rows))), rows.tolist())


def test_groups_and_hot_vectors(spark):
    """One vector that many rows have, near copies of it that mostly link with each other, and a chain."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(32)
    near = base + 0.35 * rng.standard_normal((60, 32))
    chain = [np.cos(a) * np.eye(32)[0] + np.sin(a) * np.eye(32)[1] for a in np.arange(0, 3, 0.4)]
    rows = [base.tolist()] * 80 + near.tolist() + [c.tolist() for c in chain]
    compare(spark, list(range(len(rows))), rows)


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = rng.standard_normal(24) + 0.3 * rng.standard_normal((90, 24))
    compare(spark, list(range(90)), rows.tolist())


def test_defined_cases(spark):
    rows = [[1.0, 0.0], [2.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [0.0, 1.0], [None, 1.0], [1.0, 0.0, 0.0], [3.0, 0.0, 0.0], [-0.0, 1.0], [1e-30, 0.0], [], [1.0, 0.0]]
    compare(spark, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, 11, 1], rows)
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    x = vectors.unit(planted(rng, 4000, 64, 0.5, 0.95))
    code, step, factor = vectors.codes(x)
    p, q = slice(0, 4000), slice(4000, 8000)
    true = (x[p] * x[q]).sum(1)
    signs, _ = vectors.opened(code[p])
    _, form = vectors.opened(code[q])
    dim = signs.shape[1]
    guess = (signs * form).sum(1) * step[q] / np.sqrt(dim) / factor[p]
    assert abs((guess - true).mean()) < 0.003
    assert (np.abs(guess - true) <= vectors.error(factor[p], step[q], dim)).all()
    open_ = vectors.may_link((code[p], step[p], factor[p]), (code[q], step[q], factor[q]), 0.9)
    assert open_[true >= 0.9].all() and open_[true < 0.6].mean() < 0.05
