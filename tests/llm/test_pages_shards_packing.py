"""Pages of other shapes, groups kept whole by shards, packing against a whole-shard BM25 by hand, and null ids."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import html_pages, packing, sharding

DOCS = "doc_id long, text string, shard string, length long"
LONG, MORE = "Some text of the article goes on here. " * 12, "And more of it follows after that. " * 9


@pytest.fixture(scope="module")
def models():
    return html_pages.default_models()


def text_of(page, models):
    return html_pages.extract([page], *models)[0]


def test_containers_without_telling_names(models):
    for opening in ("<div>", '<div class="c-rich__copy">', "<section>", '<div id="x1">'):
        tag = opening[1:].split()[0].rstrip(">")
        page = f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li></ul></nav>{opening}<h1>Its title</h1><p>{LONG}</p><p>{MORE}</p></{tag}><div class="comments"><div class="comment"><p>I disagree with this.</p></div></div><footer>Copyright 2020</footer></body></html>'
        assert text_of(page, models) == "\n".join(["Its title", LONG.strip(), MORE.strip()])
    assert text_of(f"<div><p>{LONG}</p><p>{MORE}</p></div>", models) == f"{LONG.strip()}\n{MORE.strip()}"


def test_quotes_in_unquoted_values(models):
    page = f"<article><p title=it's>{LONG}</p><p title='a > b' data-x=\"c > d\">{MORE}</p><p class = plain>End.</p></article>"
    assert text_of(page, models) == f"{LONG.strip()}\n{MORE.strip()}\nEnd."
    assert list(html_pages.parse("<p title=it's>one</p><p a=\"b>two</p>").texts.values())[0] == "one"
    html_pages.parse("<p " + "a='b' " * 20_000)  # an open tag of any length takes linear time


def test_pages_of_every_kind(spark):
    page = f"<article><h1>T</h1><p>{LONG}</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, "x"), (2, "v", None, "x"), (3, "v", "", "x"), (4, "v", "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>", "x")]
    out = html_pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = f"T\n{LONG.strip()}"
    assert sorted((r.page_id or 0, r.text == want) for r in out if r.page_id in (1, None)) == [(0, True), (1, True), (1, True)]
    assert {r.page_id: r.n_chars for r in out if r.page_id in (2, 3)} == {2: 0, 3: 0} and next(r for r in out if r.page_id == 4).text == "\n".join([LONG.strip()] * 3000)
    assert html_pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def cut_edges(docs, out):
    shards = {r.doc_id: r.shard for r in out}
    groups = defaultdict(list)
    for r in docs:
        groups[r.text or ""].append(shards[r.doc_id])
    return sum(a != b for g in groups.values() for i, a in enumerate(g) for b in g[:i])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equal_texts_stay_in_one_shard(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    out = sharding.balanced_shards(docs).collect()
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == k) == list(range(counts[k])) for k in (0, 39))
    assert cut_edges(docs.collect(), out) == 0


def test_a_group_larger_than_a_shard(spark):
    rows = [(k, "same" if k < 40 else f"t{k}", "x", 1) for k in range(100)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, DOCS), shards=5).collect()
    assert Counter(r.shard for r in out) == {k: 20 for k in range(5)}
    assert len({r.shard for r in out if r.doc_id < 40}) <= 4


def test_shards_of_every_kind(spark):
    rows = [(1, "a", "x", 1), (1, "a", "x", 1), (None, "a", "x", 1), (2, None, "x", 1), (3, "", "x", 1)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, DOCS), shards=2).collect()
    assert sorted((r.doc_id or 0, r.size) for r in out) == [(0, 17), (1, 17), (1, 17), (2, 16), (3, 16)] and sorted(Counter(r.shard for r in out).values()) == [2, 3]


def test_neighbours_are_those_of_bm25_by_hand():
    r = np.random.default_rng(4)
    docs = [r.integers(0, 60, r.integers(1, 40)) for _ in range(50)]
    holds = Counter(t for d in docs for t in set(d.tolist()))
    mean = sum(map(len, docs)) / len(docs)
    idf = {t: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for t, n in holds.items()}

    def score(q, d):
        tf = Counter(d.tolist())
        return sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(q.tolist()) if t in tf)

    index = packing.Index(docs, np.array([idf.get(t, 0) for t in range(60)], np.float32), mean)
    unused = r.random(50) < 0.8
    for k in range(50):
        want = {j: score(docs[k], docs[j]) for j in range(50) if unused[j]}
        found = index.neighbours(k, unused).tolist()
        assert set(found) == {j for j, s in want.items() if s > 0}
        assert all(want[a] >= want[b] - 1e-4 for a, b in zip(found, found[1:], strict=False))


def test_ids_stay_whole_beside_null_ones(spark):
    big = [2**60 + 1, 2**60 + 3, None, 2**60 + 5, 7, 7]
    rows = [(k, f"word {i % 3}" if k != 7 else None, "x", 1) for i, k in enumerate(big)]
    out = packing.pack(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0) for r in out if r.start == 0) == sorted(k or 0 for k in big) and sum(r.length for r in out) == sum({(r.doc_id, i): r.doc_tokens for i, r in enumerate(out) if r.start == 0}.values())


def test_a_long_document_is_cut_and_whole(spark):
    rows = [(1, "word " * 30_000, "x", 1), (2, "word", "x", 1)]
    out = packing.pack(spark.createDataFrame(rows, DOCS)).collect()
    long = sorted((r.start, r.length) for r in out if r.doc_id == 1)
    assert sum(n for _, n in long) == next(r.doc_tokens for r in out if r.doc_id == 1) and all(a + n == b for (a, n), (b, _) in zip(long, long[1:], strict=False))
    assert packing.pack(spark.createDataFrame([], DOCS)).where(F.lit(True)).collect() == []


def test_an_index_that_drops_used_documents_finds_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 60, n).astype("<u2") for n in rng.integers(1, 40, 200)]
    idf, mean = rng.random(60).astype(np.float32) + 1, sum(map(len, docs)) / len(docs)
    for ids in docs[:20]:
        t, w = packing._weights(ids, idf, mean, np.full(60, 7, np.int32))
        want, tf = np.unique(ids, return_counts=True)
        assert t.tolist() == want.tolist() and np.allclose(w, idf[want] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ids) / mean)))
    index, whole, unused = packing.Index(docs, idf, mean), packing.Index(docs, idf, mean), np.ones(200, bool)
    for k in rng.permutation(200):
        unused[k] = False
        index.shrink(unused)
        assert index.neighbours(k, unused).tolist() == whole.neighbours(k, unused).tolist()
    assert len(index.owners) < len(whole.owners) / 50


def test_terms_of_all_documents_are_counted_at_once():
    rng = np.random.default_rng(6)
    idf = rng.random(60).astype(np.float32) + 1
    for dtype in ("<u2", "<u4", np.int64):
        docs = [rng.integers(0, 60, n).astype(dtype) for n in (1, 2, *rng.integers(1, 40, 50))]
        mean = sum(map(len, docs)) / len(docs)
        document, t, w = packing.weights(docs, idf, mean)
        for k, ids in enumerate(docs):
            want, weight = packing._weights(ids, idf, mean, np.zeros(60, np.int32))
            assert t[document == k].tolist() == want.tolist() and np.allclose(w[document == k], weight)
        keys = packing.content_keys(docs, np.arange(len(docs)), idf, mean)
        assert (keys & np.uint64(0xFFFF)).tolist() == list(range(len(docs))) and keys[0] == np.uint64(int(docs[0][0])) << np.uint64(48)
    assert len(packing.content_keys([], np.zeros(0, np.int64), idf, 1.0)) == 0


def test_common_terms_of_a_large_shard_are_not_looked_up_document_by_document():
    rng = np.random.default_rng(7)
    docs = [np.concatenate([rng.integers(0, 40, 60), rng.integers(40, 900, 4)]).astype("<u2") for _ in range(2 * packing.TABLED)]
    idf, mean, unused = rng.random(900).astype(np.float32) + 1, 64.0, np.ones(len(docs), bool)
    index = packing.Index(docs, idf, mean)
    assert len(index.owners) <= 4 * len(docs)
    plain = {k: dict(zip(*(x.tolist() for x in packing._weights(d, idf, mean, np.zeros(900, np.int32))), strict=True)) for k, d in enumerate(docs)}
    for k in rng.permutation(len(docs))[: len(docs) - 20]:
        unused[k] = False
        index.shrink(unused)
        if k % 16 == 0:
            score = {j: sum(w for t, w in plain[j].items() if t in plain[k]) for j in np.flatnonzero(unused).tolist()}
            assert index.neighbours(k, unused).tolist() == sorted(score, key=lambda j: (-score[j], j))
