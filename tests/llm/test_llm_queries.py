"""The ten operators and the pipeline against SQL, brute force, exact round trips and held-out accuracy."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

import public_tokenizers
from oracle import same
from quillspark.llm import html_pages, langid, licences, mixing, ngram_join, ogg, packing, registry, sharding, token_files, vectors


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def ids_of(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path(name)))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf, name):
    same(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


def test_language_is_learned(spark, sf):
    lang = {r.doc_id: r.lang for r in documents(spark, sf)}
    found = registry.op2_language_id(spark, sf).collect()
    assert len(found) == len(lang) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_ogg_round_trip(spark, sf):
    texts = {r.doc_id: r.text for r in documents(spark, sf)}
    found = registry.op4_ogg_media(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))


def test_token_files_round_trip(spark, sf):
    encode, start = ids_of("byte_bpe_50k.json"), 0
    found = {r.doc_id: r for r in registry.op6_token_files(spark, sf).collect()}
    for d in sorted(documents(spark, sf), key=lambda r: r.doc_id):
        ids, r = encode(d.text), found[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def check_packed(found, texts):
    encode, pieces, sequences = ids_of("word_bpe_49k.json"), defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for k, rows in pieces.items():
        ids, at = encode(texts[k]), 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_packing_holds_each_id_once(spark, sf):
    check_packed(registry.op7_lexical_packing(spark, sf).collect(), {r.doc_id: r.text for r in documents(spark, sf)})


def test_packing_deals_related_documents_to_one_shard(spark):
    import random

    r, encode, texts = random.Random(3), ids_of("word_bpe_49k.json"), {}
    words = ["".join(r.choices("aeioulnrst", k=r.randint(3, 9))) for _ in range(4000)]
    for group in range(80):
        base = r.choices(words, k=120)
        for k in range(8):
            texts[len(texts)] = " ".join(r.choice(words) if r.random() < 0.03 * k else w for w in base)
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    found = packing.pack(docs, docs_per_shard=64).collect()
    check_packed(found, texts)
    shard = {x.doc_id: x.sequence_id >> 32 for x in found}
    assert max(shard.values()) >= 5
    ids = [np.array(encode(texts[k]), np.uint16) for k in range(len(texts))]
    holds = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=50_000)
    index = packing.Index(ids, np.log1p((len(ids) - holds + 0.5) / (holds + 0.5)).astype(np.float32), sum(map(len, ids)) / len(ids))
    best = [index.neighbours(k, np.arange(len(ids)) != k)[0] for k in range(len(ids))]
    # of neighbours over all documents; dealing by doc_id reaches a tenth
    assert sum(shard[k] == shard[b] for k, b in enumerate(best)) >= 0.6 * len(ids)


def test_licences_in_the_forms_of_real_files(spark):
    import textwrap

    mit, bsd, gpl = licences.KNOWN["MIT"], licences.FILES["BSD-3-Clause"], licences.FILES["GPL-2.0"]
    texts = {
        "MIT": ["MIT License\n\nCopyright (c) 2020 A Person\n\n" + mit, "# The MIT License (MIT)\n\nCopyright © A Person\n\n" + mit, mit, "MIT License\n\nCopyright A Person and others\n\n" + mit],
        "BSD-2-Clause": [textwrap.fill(licences.KNOWN["BSD-2-Clause"], w) for w in range(20, 100)],
        "BSD-3-Clause": ["BSD 3-Clause License\n\nCopyright (c) 2009, A Person\nAll rights reserved.\n\n" + bsd.replace("copyright holder nor", "Example Foundation nor"), bsd, *(textwrap.fill(bsd, w) for w in range(20, 100))],
        "WTFPL": [licences.FILES["WTFPL"], licences.KNOWN["WTFPL"]],
        "GPL-2.0": [gpl, gpl[gpl.index("Preamble") :], gpl.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"), gpl[: gpl.index("How to Apply These Terms")]],
        "CC0-1.0": [licences.FILES["CC0-1.0"], licences.FILES["CC0-1.0"].split("HEREUNDER.\n")[1]],
        "Apache-2.0": [licences.FILES["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 A Person"), *(textwrap.fill(licences.FILES["Apache-2.0"].split("APPENDIX")[0], w) for w in (40, 72, 90))],
        **{k: [licences.FILES[k]] for k in ("Unlicense", "GPL-1.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")},
        None: ["MIT License", "Copyright (c) 2020 A Person", mit + " And more.", bsd.replace("are permitted", "are not permitted"), "the name of"],
    }
    rows = [(k, t, i) for i, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)]
    found = {r.doc_id: r.license for r in licences.scan(spark.createDataFrame([(i, t) for _, t, i in rows], "doc_id long, text string")).collect()}
    assert [(k, found[i], t[:200]) for k, t, i in rows if found[i] != k] == []


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    parents, levels = np.array([-1, 0, 0, 1]), [np.array([0]), np.array([1, 2]), np.array([3])]
    local, edge, total = r.normal(size=4), r.normal(size=(2, 2)), np.zeros(5)
    for state in np.ndindex(2, 2, 2, 2):
        s = np.array(state)
        w = np.exp((local * s).sum() + edge[s[parents[1:]], s[1:]].sum())
        total += w * np.array([1, *s])
    assert np.allclose(html_pages.sum_product(local, edge, parents, levels)[0], total[1:] / total[0])


def test_main_text(spark):
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One  two\nthree four five six seven.</p><script>x()</script></article><footer>Copyright 2020</footer></body></html>'
    want = "A & B\nOne two three four five six seven."
    df = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, None, "")], "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_chars) for r in html_pages.main_text(df).collect()} == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}


@pytest.mark.parametrize(
    "tag",
    ["<svg/>", '<svg class="icon" />', "<svg width=1 />", "<svg hidden/>", "<svg viewBox='0 0 1 1'/>", "<template>", "<noscript>", "<iframe src=/x>", "<svg>", "<textarea>", "<svg><path/></svg>", "<iframe src=/x/></iframe>", "<script>x()</script>"],
)
def test_text_after_raw_tags_stays(tag):
    tree = html_pages.parse(f"<body><p>Before.</p>{tag}<p>After.</p></body>")
    assert list(tree.texts.values()) == ["Before.", "After."]
    assert list(html_pages.parse("<body><p>Before.</p><script>x() <p>After.</p>").texts.values()) == ["Before."]
    assert list(html_pages.parse("<p>a</p><svg/><p>b</p><svg><text>no</text></svg><p>c</p>").texts.values()) == ["a", "b", "c"]


def test_shards(spark, sf):
    texts = {r.doc_id: r.text for r in documents(spark, sf)}
    found, slots, sizes = registry.op10_balanced_shards(spark, sf).collect(), defaultdict(list), defaultdict(int)
    assert len(found) == len(texts)
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw)) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len({r.law for r in found}) == 1
    counts = [len(slots[k]) for k in range(40)]
    assert found[0].law != "rows" or max(counts) - min(counts) <= 1


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, id string, key string, n string"
ON_DOCUMENTS = {
    "mix": mixing.mix,
    "identify": langid.identify,
    "scan": licences.scan,
    "ogg": lambda d: ogg.features(ogg.encode_column(d)),
    "ngram": ngram_join.join,
    "tokens": lambda d: token_files.read_files(token_files.write_files(d)),
    "pack": packing.pack,
    "shards": sharding.balanced_shards,
}


@pytest.mark.parametrize("name", sorted(ON_DOCUMENTS))
def test_nulls_repeats_and_clashing_names(spark, name):
    long = "word " * 30_000
    texts = [None, "", " \n", "one", "the same words here " * 5, "the same words here " * 5, long, "日本 語 …"]
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 2 else "a", None, "x", "y", "z", "w") for k, t in enumerate(texts)]
    out = ON_DOCUMENTS[name](spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in out} == set(range(len(texts))) if name != "scan" else out is not None


@pytest.mark.parametrize("name", sorted(ON_DOCUMENTS))
def test_empty_table(spark, name):
    assert ON_DOCUMENTS[name](spark.createDataFrame([], DOCS)).collect() == []


def test_vectors_nulls_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (6, [None, 1.0])]
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {0: (1, 0, True), 1: (1, 0, False), **{k: (0, k, True) for k in (2, 3, 4, 5, 6)}}


def test_pipeline_stages_keep_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    known = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert known.columns == columns and known.count() <= len(texts)
    alone = corpus_pipeline.STAGES[1][1](spark, docs, sf)
    want = {r.doc_id for r in ngram_join.join(docs, size=5, percent=80).collect() if r.doc_id == r.component_id}
    assert alone.columns == columns and {r.doc_id for r in alone.collect()} == want
    assert corpus_pipeline.STAGES[2][1](spark, docs, sf).columns == columns


def test_keep_one_goes_by_texts(spark):
    copy = " ".join(f"w{i}" for i in range(60))
    other, third, fourth = ("an unrelated text of its own", "quite another one it is", "a last text with nothing alike")
    rows = [(None, other, "a"), (None, third, "b"), (5, fourth, "c"), (5, copy, "d"), (5, copy, "d"), (4, copy, "e"), (None, copy, "f"), (None, None, "g"), (None, None, "g"), (6, " ", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sorted(r.source for r in ngram_join.keep_one(docs).collect())
    assert found == ["a", "b", "c", "e", "g", "g", "h"]


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_word_encoder_equals_the_library(name, spaces):
    import random

    import pyarrow as pa
    from quillspark.llm.tokens import WordEncoder, vocabulary_path
    from tokenizers import Tokenizer

    r, library = random.Random(5), Tokenizer.from_file(vocabulary_path(name))
    signs = [*"aAbHTJWYsS'ß éÉİıſḴ̈̊̌ ,.;:!?#%<|>_-`\n\t\r\x0b\x1c\x85　 09²½中σΣς  ", "'s", "'LL", "<|endoftext|>", " the", "Word, ", "x### ", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = [None, "", " ", "a,", *("".join(r.choices(signs, k=r.randint(0, 30))) for _ in range(5000))]
    ids, n = WordEncoder(vocabulary_path(name), spaces).encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    for k, want in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == want.ids, texts[k]


def test_word_sums_equal_enumeration():
    """Sums over all segmentations of whole words, short, long and longer than a window, against every one of them."""
    import itertools

    class Few:
        longest, size = 3, 5
        ids = {"a": 0, "ab": 1, "bab": 2, "b": 3, "ba": 4}

        def find(self, h):
            known = {}
            for text, i in self.ids.items():
                x = 0
                for c in text:
                    x = (x * 1_000_003 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                known[x] = i
            return np.array([known.get(int(x), -1) for x in h], np.int32)

    r = np.random.default_rng(3)
    probability = np.concatenate([r.random((5, 2)), np.full((1, 2), langid.UNKNOWN)])

    def every(word):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[at:i])
                    at = i
            if all(p in Few.ids or len(p) == 1 for p in parts):
                total += np.prod([probability[Few.ids.get(p, -1)] for p in parts], axis=0)
        return np.log(total)

    words = ["a", "abab", "xab", "babab" * 2, "abxbaabba", "bababbabaabab"]
    assert np.allclose(langid.log_forward(words, probability, Few()), [every(w) for w in words])
    assert np.allclose(langid._log_forward_long(sorted(words, key=len, reverse=True), probability, Few()), [every(w) for w in sorted(words, key=len, reverse=True)])
    # beyond enumeration: by the plain recurrence
    word, sums = "abbab" * 60, [np.ones(2)]
    for i in range(1, len(word) + 1):
        parts = [(word[j:i], sums[j]) for j in range(max(0, i - 3), i)]
        sums.append(sum(x * probability[Few.ids.get(p, -1)] for p, x in parts if p in Few.ids or len(p) == 1))
    assert np.allclose(langid.log_forward([word, word[:40]], probability, Few()), np.log([sums[300], sums[40]]))


def test_words_in_small_chunks(monkeypatch):
    import pyarrow as pa
    from quillspark.llm import shingles

    texts = pa.array([None, "", " a\tB ", "c" * 9000 + " d", "a b " * 50, "é É", " "])
    want = shingles.words(texts)
    for chunk in (1, 7, 64):
        monkeypatch.setattr(shingles, "CHUNK", chunk)
        assert all((x == y).all() for x, y in zip(want, shingles.words(texts), strict=True))
    assert want[1].tolist() == [0, 0, 2, 2, 100, 2, 0]


def test_a_slice_takes_little_memory():
    import tracemalloc

    import pyarrow as pa
    from quillspark.llm import shingles

    column = pa.array([" ".join(f"w{i % 977}" for i in range(k, k + 200_000)) for k in range(1)])
    tracemalloc.start()
    shingles.shingle_sets(column, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * column.nbytes + 60 * shingles.CHUNK


def jaccard_components(texts, size, percent):
    """The smallest id of each text's component, by all pairs."""
    import re

    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    label = {k: k for k in texts}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {k: find(k) for k in keys}


def test_pipeline_from_end_to_end(spark, sf):
    import corpus_pipeline

    texts = {r.doc_id: r.text or "" for r in documents(spark, sf)}
    lettered = {k: t for k, t in texts.items() if any(c.isalpha() for c in t)}
    kept = {k for k, c in jaccard_components(lettered, 5, 80).items() if k == c}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= kept
    encode, pieces, sequences = ids_of("word_bpe_49k.json"), defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, rows in pieces.items():
        ids = encode(texts[k])
        times, rest = divmod(sum(r.length for r in rows), len(ids))
        assert 1 <= times <= 3 and rest == 0 and all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in rows)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
