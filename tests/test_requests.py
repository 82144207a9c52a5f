"""Relations of many requests, answers stored in one batch, and ids of sparse numbers, against plain loops."""

import math
import os
import random

import pytest

from quillspark.operators import dictionary, graph, imports, memory, stored, vector_index


def relations_by_hand(triples, requests, expand_by, direct, expand, expanded):
    out = set()
    spo = sorted({t[:3] for t in triples})
    for r, names in requests.items():
        near = [t for t in spo if t[0] in names or t[2] in names][:direct]
        other = sorted({x for t in near if t[1] in expand_by for x in (t[0], t[2])} - names)[:expand]
        far = [t for t in spo if t[0] in other or t[2] in other][:expanded]
        out |= {(r, *t, 0) for t in near} | {(r, *t, 1) for t in far if t not in near}
    return out


def test_relations_of_requests_with_limits_and_a_common_entity(spark):
    r = random.Random(2)
    triples = [(f"e{r.randint(0, 12)}", r.choice(["a", "b"]), f"e{r.randint(0, 12)}", r.random()) for _ in range(200)] + [("hub", "a", f"n{i}", 0.5) for i in range(60)]
    requests = {i: {f"e{r.randint(0, 12)}" for _ in range(r.randint(1, 3))} | ({"hub"} if i % 2 else set()) for i in range(20)} | {20: {"nobody"}}
    t = spark.createDataFrame(triples * 2, "subject string, predicate string, object string, confidence double")
    q = spark.createDataFrame([(i, x) for i, names in requests.items() for x in names] * 2 + [(21, None)], "request long, entity string")
    got = graph.relations_of_requests(t, q, ("a",), direct=9, expand=3, expanded=6).select("request", "subject", "predicate", "object", "hop").collect()
    want = relations_by_hand(triples, requests, ("a",), 9, 3, 6)
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_founders_are_those_of_one_after_the_other(spark):
    r = random.Random(3)
    pairs = {(a, b) for a in range(60) for b in range(a) if r.random() < 0.06} | {(i, i - 1) for i in range(61, 90)}
    found = []
    for i in range(90):
        if not any((i, f) in pairs for f in found):
            found.append(i)
    got = memory.founders(spark.createDataFrame([(i,) for i in range(90)], "new_id long"), spark.createDataFrame(sorted(pairs), "new_id long, earlier long"))
    assert sorted(x.new_id for x in got.collect()) == found


ENTRY = "question string, answer string, entities array<string>, tags array<string>, citations array<string>, quality double"


def answer(n, quality):
    return (f"q{n}", f"a{n}", [f"e{n}"], ["t"], [f"c{n}"], quality)


def test_equal_new_answers_are_merged_in_the_batch(spark):
    east, near_east, north, west = [1.0, 0.0], [0.98, 0.199], [0.0, 1.0], [-1.0, 0.0]
    entries = spark.createDataFrame([(7, *answer(7, 0.7), 3)], f"id long, {ENTRY}, hits long")
    new = spark.createDataFrame([(1, *answer(1, 0.7)), (2, *answer(2, 0.9)), (3, *answer(3, 0.6)), (4, *answer(4, 0.8)), (5, *answer(5, 0.8)), (6, *answer(6, 0.66))], f"new_id long, {ENTRY}")
    vectors = spark.createDataFrame([(7, west), (8, north)], "id long, vector array<double>")
    new_vectors = spark.createDataFrame([(1, east), (2, near_east), (3, east), (4, north), (5, west), (6, near_east)], "new_id long, vector array<double>")
    got = {r.id: (r.question, r.quality, r.hits, sorted(r.citations)) for r in memory.store_batch(entries, new, vectors, new_vectors).collect()}
    assert got == {7: ("q5", 0.8, 4, ["c5", "c7"]), 8: ("q2", 0.9, 2, ["c1", "c2", "c6"]), 9: ("q4", 0.8, 0, ["c4"])}
    none = new.where("new_id < 0")
    assert memory.store_batch(entries, none, vectors, new_vectors).count() == 1


def test_ids_of_numbers_far_apart(spark):
    numbers = [-(2**62), -70000, -1, 0, 1, 65535, 65536, 2**33, 2**33 + 1, 2**50, 2**62]
    got = imports.with_ids(spark.createDataFrame([(n,) for n in numbers], "seq long"), "seq", "id", 5).collect()
    assert {r.seq: r.id for r in got} == {n: k for k, n in enumerate(numbers, 6)}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_upsert_rewrites_the_buckets_of_its_keys_alone(spark):
    rows = spark.createDataFrame([("e", f"a{i}", "s", 0.5, i) for i in range(100)], "entity string, alias string, source string, confidence double, seq long")
    store = stored.BucketedTable.create(rows, ("entity", "alias"), buckets=16)
    before = files(store.path)
    new = spark.createDataFrame([("e", "a3", "t", 0.2, 200), ("e", "new", "t", 0.9, 201)], rows.schema)
    store.upsert(new, graph.upsert_aliases)
    assert len(before - files(store.path)) <= 2 and len(before & files(store.path)) >= len(before) - 2
    got = {r.alias: (r.source, r.confidence) for r in store.read().collect()}
    assert len(got) == 101 and got["a3"] == ("t", 0.5) and got["new"] == ("t", 0.9) and got["a4"] == ("s", 0.5)
    store.upsert(new.where("false"), graph.upsert_aliases)
    store.upsert(new, graph.upsert_aliases)  # again: nothing changes
    assert {r.alias: (r.source, r.confidence) for r in store.read().collect()} == got


def test_a_batch_that_stops_between_two_stores_is_not_seen_until_it_is_written_again(spark):
    both = stored.TwoStores.create(spark)
    assert both.read("chunks") is None
    a, b = (spark.createDataFrame([(i, f"x{i}") for i in ids], "id long, x string") for ids in ((1, 2), (3, 4, 5)))
    assert both.write("one", {"chunks": a, "vectors": a})

    class Broken:
        @property
        def write(self):
            raise OSError("the second store is down")

    with pytest.raises(OSError, match="second store"):
        both.write("two", {"chunks": b, "vectors": Broken()})
    assert both.read("chunks").count() == 2 and both.read("vectors").count() == 2
    assert both.write("two", {"chunks": b, "vectors": b}) and not both.write("two", {"chunks": a, "vectors": a})
    assert sorted(r.id for r in both.read("chunks").collect()) == sorted(r.id for r in both.read("vectors").collect()) == [1, 2, 3, 4, 5]


def test_names_of_a_dictionary_equal_the_nested_loop(spark):
    r = random.Random(6)
    names = ["a", "ab", "abc", "番茄", "番茄炒蛋", "茄", "zz", "b\nc", "x" * 40, "", None, "ab"]
    texts = [(i, "".join(r.choice(["a", "b", "c", "番", "茄", "炒", "蛋", "z", "\n", "x" * 20]) for _ in range(60))) for i in range(30)] + [(30, None), (31, ""), (32, "a")]
    got = {tuple(x) for x in dictionary.mentions(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    want = set()
    for i, t in texts:
        for n in {n for n in names if n}:
            at = [k for k in range(len(t or "")) if t.startswith(n, k)]
            want |= {(i, n, at[0], len(at))} if at else set()
    assert got == want
    assert dictionary.mentions(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([], "n string"), "n").collect() == []


def test_places_of_names_are_code_points_also_in_texts_of_several_steps(spark, monkeypatch):
    texts = [(1, "😀ab😀abc"), (2, "x" * 9 + "abc" + "y" * 8 + "abc😀" + "ab" * 30), (2, "abc")]
    names = spark.createDataFrame([("ab",), ("abc",), ("😀a",), ("yabc😀ab",)], "n string")
    t = spark.createDataFrame(texts, "id int, t string")
    got = {tuple(x) for x in dictionary.mentions(t, "id", "t", names, "n").collect()}
    assert got == {(1, "ab", 1, 2), (1, "abc", 4, 1), (1, "😀a", 0, 2), (2, "ab", 0, 33), (2, "abc", 0, 3), (2, "😀a", 23, 1), (2, "yabc😀ab", 19, 1)}
    has, sizes = dictionary.np.ones(1 << 16, bool), [2, 3]
    whole, in_steps = dictionary._places(next(dictionary._pieces([b"abcdefghij"], 3)), sizes, has), []
    monkeypatch.setattr(dictionary, "STEP", 4)
    for group in dictionary._pieces([b"abcdefghij"], 3):
        chars, at, n, piece = dictionary._places(group, sizes, has)
        start = dictionary.np.cumsum([0, *(len(g[2]) for g in group)])
        in_steps += [(int(a - start[g] + group[g][1]), int(k), chars[a : a + k]) for a, k, g in zip(at, n, piece)]
    assert sorted(in_steps) == sorted((int(a), int(k), whole[0][a : a + k]) for a, k in zip(*whole[1:3]))


def test_rows_within_a_similarity_move_no_vectors_however_many_cells_they_reach(spark, monkeypatch):
    r = random.Random(8)
    made = [[r.gauss(0, 1) for _ in range(16)] for _ in range(200)]
    made += [[x + r.gauss(0, 0.1) for x in made[k % 7]] for k in range(100)]
    rows = spark.createDataFrame(list(enumerate(made)) + [(300, None), (301, [0.0] * 16), (302, [1.0])], "key long, v array<double>")
    index = vector_index.build(rows, "key", "v", "cosine", cells=8)
    monkeypatch.setattr(vector_index, "SENT_ROWS", 100)
    found = vector_index.within(index, rows, "key", "v", 0.92)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    unit = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in made]
    value = {(a, b): round(sum(x * y for x, y in zip(unit[a], unit[b])), 6) for a in range(300) for b in range(300)}
    assert sorted((x.query, x.key) for x in found.collect()) == sorted(k for k, v in value.items() if v >= 0.92)
    assert vector_index.within(vector_index.build(rows.where("key >= 300"), "key", "v", "cosine"), rows, "key", "v", 0.92).count() == 1
