"""Pages of odd kinds, sources without words, and rows with columns of any name and type."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import html_pages, langid, mixing, ngram_join, tokens

P = "This paragraph has a dozen ordinary words in it and then stops here."
NAV = "<nav><ul><li><a href=/>Home</a></li></ul></nav>"


@pytest.fixture(scope="module")
def model():
    return html_pages.default_models()[0]


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{P}</p></article>", P),
        (f"<article><p>{P * 3}</p><p>{P * 3}</p><div class=notice>Please accept</div></article>", f"{P * 3}\n{P * 3}"),
        (f"<article><p><a href=x>{P}</a></p><p>{P}</p><ul><li>one thing</li><li>two things</li></ul></article>", f"{P}\n{P}\none thing\ntwo things"),
        (f"<body><p>{P * 5}</p><p>{P * 5}</p></body>", f"{P * 5}\n{P * 5}"),
        ("<body><p>short</p></body>", "short"),
        ("Just plain text of a page.", "Just plain text of a page."),
        (f"<article><h1>T</h1><p>{P}</p><p>{P * 2}</p><section class=comments><p>Reader says things.</p></section></article>", f"T\n{P}\n{P * 2}"),
        (f'<body>{NAV}<article><h1>T</h1><p>{P}</p><section class="comments"><h3>Comments</h3><div class=comment><p>Reader: {P}</p></div></section></article><footer>c</footer></body>', f"T\n{P}"),
        (f'<body><div class=ad>Buy now</div><article><h1>T</h1><p>{P}</p><div class="ad">Buy {P}</div><p>{P * 2}</p></article></body>', f"T\n{P}\n{P * 2}"),
        (f"<body>{NAV}<p>{P * 2}</p><p>{P}</p><aside><p>{P}</p></aside><footer>(c) 2020 me</footer></body>", f"{P * 2}\n{P}"),
        (f"<body><header><h1>Site</h1></header><main><p>{P}</p></main><footer><p>{P}</p></footer></body>", P),
        (f"<body><div id=root><div class=top><a href=/>Home</a></div><div><div><p>{P}</p><p>{P}</p></div></div></div></body>", f"{P}\n{P}"),
    ],
)
def test_whole_articles_without_their_surroundings(model, page, want):
    assert html_pages.extract([page], model) == [want]


def test_blocks_of_pages_that_the_model_has_not_seen(model):
    right = count = 0
    for page in html_pages.training_pages(200, seed=99):
        tree = html_pages.parse(page, int(page.startswith(html_pages.ROOT_IS_CONTENT)))
        leaves = np.array(sorted(tree.texts))
        right += ((html_pages.marginals([tree], model)[0][leaves] > 0.5) == (np.array(tree.labels)[leaves] > 0)).sum()
        count += len(leaves)
    assert right >= 0.99 * count


def test_a_source_without_words_is_taken_none_of(spark):
    rows = [(1, "a b c", "x"), (2, None, "y"), (3, "", "y"), (4, " \t", None), (None, "d e", "x"), (5, "f", "x")]
    found = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(found) == 6
    assert all((found[k].size, found[k].source_size, found[k].target, found[k].taken) == (0, 0, 0.0, 0) for k in (2, 3, 4))
    assert sum(r.taken for r in found.values()) == 6 and found[1].target == 6.0


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _copies int, _copy int, _m binary, _r string, row string, mark int, turn long, times long, h int, size int, map map<string,int>, parts array<struct<a:int>>"


def extra(doc_id, text, source):
    return (doc_id, text, "en", source, 1, 7, 8, b"m", "r", "row", 1, 2, 3, 4, 5, {"k": doc_id or 0}, [(1,)])


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stages_keep_columns_of_any_name_and_type(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [extra(1, long, "x"), extra(2, long, "x"), extra(2, long, "x"), extra(3, "some other text of its own", "x"), extra(None, "text without a number to it", None), extra(None, None, "y"), extra(4, "", "y")]
    df = spark.createDataFrame(rows, EXTRA)
    kept = ngram_join.keep_one(df, size=5, percent=80)
    assert kept.columns == df.columns
    assert rows_of(kept) == rows_of(spark.createDataFrame([rows[0], *rows[3:]], EXTRA))
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    plan = mixing.mix(df).where("copies > 0 and size > 0").select("doc_id", "copies").distinct().collect()
    want = [x for x in rows for r in plan if r.doc_id == x[0] and (x[1] or "").strip() for _ in range(r.copies)]
    assert rows_of(mixed) == rows_of(spark.createDataFrame(want, EXTRA))


def test_copies_are_of_the_own_source(spark):
    """The sources' rows share a doc_id but not its copies."""
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, words(10), "a"), (1, words(90), "b"), (2, words(10), "a"), (3, words(900), "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {(r.doc_id, r.source): r["count"] for r in mixing.mix_documents(df).groupBy("doc_id", "source").count().collect()}
    plan = {(r.doc_id, r.source): r.copies for r in mixing.mix(df).where(F.col("copies") > 0).collect()}
    assert taken == plan


def test_vectors_of_doubles_keep_their_size(spark):
    from quillspark.llm import vectors

    rows = [(1, [1e300, 0.0]), (2, [1e300, 1.0]), (3, [1e-60, 0.0]), (4, [0.0, 1e-60]), (5, [1.0, 1e-9]), (6, [0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}


def test_token_files_of_documents_that_share_a_number(spark, monkeypatch):
    from collections import Counter

    from quillspark.llm import token_files

    monkeypatch.setattr(token_files, "IDS_PER_PARTITION", 200)
    rows = [(None if i % 3 else 7, f"text number {i} of many") for i in range(120)] + [(9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = token_files.write_files(df)
    got = token_files.read_files(files).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and len({r.ids_crc32 for r in got}) == 121
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert files.select("part").distinct().count() > 1


def test_a_worker_keeps_one_vocabulary_at_a_time(monkeypatch):
    freed = []
    monkeypatch.setattr(tokens, "_held", {})
    monkeypatch.setattr(tokens, "release", lambda: freed.append(1))
    path = tokens.vocabulary_path("word_bpe_49k.json")
    enc = tokens.encoder(path, False, 3)
    assert tokens.encoder(path, False, 3) is enc and freed == []
    column = pa.array(["one two three four five six", None, "six seven two nine"])
    ids, n = enc.encode(column)
    again, m = enc.encode(column)  # above its bound words are learned for one call
    whole, k = tokens.WordEncoder(path, False).encode(column)
    assert ids.tolist() == again.tolist() == whole.tolist() and n.tolist() == m.tolist() == k.tolist()
    langid.pieces(tokens.vocabulary_path("piece_bpe_32k.model"))
    assert len(tokens._held) == 1 and freed == [1] and tokens.encoder(path, False, 3) is not enc
    tokens.drop_held()
    assert tokens._held == {} and len(freed) == 3
