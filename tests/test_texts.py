import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import blocks, chunks, classes, evaluation, facts, guarded_sql, imports, memory, planning, routing
from quillspark.sources import records


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_blocks(spark):
    text = "# T\nbody\n\n  - a \n* b\ntail\n| h | k |\n|---|---|\n| 1 | |\n\n| alone |\n#no"
    assert [tuple(b) for b in one(spark, blocks.block_list, text)] == [("text", "# T\nbody"), ("list", "- a\n- b"), ("text", "tail"), ("table", "| h | k |\n|---|---|\n| 1 | |"), ("text", "#no")]
    assert one(spark, blocks.block_list, None) == [] and one(spark, blocks.block_list, " \n\t") == []
    assert one(spark, lambda c: blocks.title(blocks.block_list(c)), "x\n\n## The  title \ny") == "The  title"
    t = one(spark, blocks.table_cells, "| h | k |\n|---|---|\n| 1 | |\n|  |  |")
    assert t.headers == ["h", "k"] and t.rows == [["1", ""]]  # a line of blanks is a separator too
    assert one(spark, lambda c: blocks.clean_table(blocks.table_cells(c)), "| a  b | k |\n| | |").rows == []


def test_a_long_text_takes_one_pass(spark):
    text = "\n\n".join(f"paragraph {i}" for i in range(20_000))
    assert len(one(spark, blocks.block_list, text)) == 20_000


def test_a_filter_on_the_class_stays_above_it(spark):
    d = spark.createDataFrame([(1, "菜谱 步骤1 将番茄切块"), (2, "血压"), (3, None)], "id int, text string")
    c = classes.classified(d, "text").where("category = 'recipe'")
    assert [r.id for r in c.collect()] == [1]
    assert {r.id: r.category for r in classes.classified(d, "text").collect()} == {1: "recipe", 2: "unknown", 3: "unknown"}


def test_recipe_steps(spark):
    text = "前言\n\n1. 将番茄切块\n再切\n\n步骤2：炒"
    assert one(spark, lambda c: chunks.recipe_steps(blocks.block_list(c)), text) == ["前言", "1. 将番茄切块\n再切", "步骤2：炒"]


def test_daily_chunks_keep_dates_together(spark):
    text = "2024-01-01 早餐\n\n午餐\n\n2024-01-02 晚餐\n\n2024-01-01 加餐"
    got = one(spark, lambda c: chunks.daily_chunks(blocks.block_list(c), F.lit("2024-01-01")), text)
    assert {(c.label, c.content) for c in got} == {("2024-01-01", "2024-01-01 早餐\n午餐\n2024-01-01 加餐"), ("2024-01-02", "2024-01-02 晚餐")}


def cosine(a, b):
    """By dense vectors, one number at a time."""
    import hashlib
    import re

    def vector(s):
        v = [0.0] * 384
        for t in re.findall(r"[A-Za-z]+|[一-鿿]", s) or [s]:
            d = hashlib.md5(t.encode()).digest()
            v[int(d[:4].hex(), 16) % 384] += 1.0 if d[4] % 2 == 0 else -1.0
        return v

    x, y = vector(a), vector(b)
    norms = (sum(p * p for p in x) ** 0.5 or 1.0) * (sum(q * q for q in y) ** 0.5 or 1.0)
    return sum(p * q for p, q in zip(x, y, strict=True)) / norms


def test_similarity_parts():
    a, b = "番茄鸡蛋牛奶豆腐。", "跑步游泳健身力量。"
    assert chunks.hashed_similarity(a, a) == pytest.approx(1) and chunks.hashed_similarity(a, b) == pytest.approx(cosine(a, b)) and cosine(a, b) < 0.5
    long_a, long_b = a * 20, b * 20  # 126 tokens each
    parts = chunks.split_by_similarity(long_a + long_b)
    assert parts == [long_a, a * 8 + long_b]  # eight sentences of six tokens are the overlap of 50
    assert chunks.split_by_similarity(a + b) == [a + b]  # too small to stand alone
    assert chunks.split_by_similarity("") == [] and chunks.split_by_similarity("x") == ["x"]
    whole = "好" * 2000 + "。"
    assert "".join(chunks.split_by_similarity("短。" + whole, overlap=0)).startswith("短。") and max(map(len, chunks.split_by_similarity(whole + whole, overlap=0))) <= 358


def test_clause_parts():
    assert chunks.split_by_clauses("番茄红，但是酸。鸡蛋") == ["番茄红，，但是酸。鸡蛋"]
    text = "".join(f"第{i}句话说了一些事情。" for i in range(200))
    parts = chunks.split_by_clauses(text)
    assert len(parts) > 1 and all(int(len(p) * 0.7) <= 620 for p in parts) and parts[0].startswith("第0句")
    for p, q in zip(parts, parts[1:], strict=False):
        assert any(q.startswith(p[-k:]) for k in range(1, 120))


def test_split_long_keeps_other_columns(spark):
    d = spark.createDataFrame([(1, "短"), (2, "很长的一句话。" * 200), (3, None)], "id int, text string")
    got = chunks.split_long(d, "text").orderBy("id", "part").collect()
    assert [r.part for r in got if r.id == 2] == list(range(len([r for r in got if r.id == 2]))) and len([r for r in got if r.id == 2]) > 1
    assert [r.text for r in got if r.id != 2] == ["短", None] and d.columns == ["id", "text"]


def test_facts(spark):
    assert one(spark, facts.primary_entity, "番茄营养丰富") == "番茄" and one(spark, facts.primary_entity, "无") is None
    j = json.dumps({"attributes": {"a": ["x", "", "y"], "b": "", "c": 3}, "amount": "5", "confidence": 0.4}, ensure_ascii=False)
    assert [tuple(a) for a in one(spark, facts.attributes_of, j)] == [("a", "x、y", 0.4), ("c", "3", 0.4), ("amount", "5", 0.4)]
    assert one(spark, facts.attributes_of, "not json") == []
    f = spark.createDataFrame([("番茄", "搭配", "鸡蛋和牛奶", 0.9, 1), ("番茄", "禁忌", "无", 0.8, 2), ("番茄", "热量", "15", 0.7, 3)], "entity string, attr string, value string, confidence double, seq long")
    known = spark.createDataFrame([("鸡蛋",), ("牛奶",), ("番茄",)], "entity string")
    assert {(r.predicate, r.object, r.object_type) for r in facts.triples_of_facts(f, known).collect()} == {("pairs_with", "鸡蛋", "ingredient"), ("pairs_with", "牛奶", "ingredient"), ("contraindicated_for", "无", "description"), ("热量", "15", "nutrient_value")}


def test_plans(spark):
    def strong(q):
        return one(spark, lambda c: planning.strong_rule(c, planning.entities(c), planning.content_class(c)), q)

    assert strong("痛风可以吃虾吗").intent == "disease_diet" and strong("蛋白质大于10g的食物有哪些").routes == ["text2sql"]
    assert strong("我花生过敏，帮我记住").intent == "profile_management" and strong("番茄炒蛋怎么做").intent == "recipe_instruction" and strong("你好") is None
    assert one(spark, planning.clean_routes, ["relation", "x", "relation", "semantic"], "array<string>") == ["relation", "semantic"]


def states(spark, **changes):
    r = spark.createDataFrame([("痛风可以吃虾吗", changes.pop("intent", "general"), ["虾"], changes.pop("planned", []))], "query string, intent string, entities array<string>, planned array<string>")
    return routing.start(r).withColumns({k: F.lit(v) if not isinstance(v, list) else (F.array(*map(F.lit, v)) if v else F.array()).cast("array<double>" if k in ("semantic", "relation_scores") else "array<string>") for k, v in changes.items()})


def test_router(spark):
    s = routing.step(states(spark, intent="disease_diet", planned=["bogus", "text2sql"])).first()
    assert (s.next_route, s.planned, s.errors) == ("semantic", ["relation", "text2sql"], ["invalid_route_filtered", "intent_route_enforced"])
    s = routing.step(states(spark, executed=["semantic"], next_route="semantic")).first()
    assert (s.next_route, s.fallbacks) == ("relation", ["relation"])
    s = routing.step(states(spark, executed=["text2sql"], next_route="text2sql", reason="schema_mismatch")).first()
    assert s.next_route == "relation"
    s = routing.step(states(spark, intent="safety_check", executed=["relation", "semantic"], next_route="semantic", semantic_retries=1)).first()
    assert (s.next_route, s.decision) == ("clarify", "high_risk_no_evidence")
    s = routing.step(states(spark, planned=["relation"], executed=["semantic"], next_route="semantic", semantic=[0.9] * 8)).first()
    assert (s.next_route, s.decision, s.planned) == ("rerank", "semantic_evidence_sufficient", [])
    s = routing.step(states(spark, planned=["text2sql"], steps=6)).first()
    assert (s.next_route, s.decision) == ("rerank", "max_router_steps_exceeded")
    s = routing.step(states(spark, executed=["relation"], next_route="relation", relation_texts=["花生 x"], relation_scores=[0.8])).first()
    assert s.next_route == "semantic" and "dynamic_route_added" in s.errors


def test_every_run_ends(spark):
    r = spark.createDataFrame([("q", "general", ["虾"], ["semantic"]), ("q", "safety_check", ["虾"], [])], "query string, intent string, entities array<string>, planned array<string>")
    assert {x.next_route for x in routing.run(r, lambda s: s).collect()} <= set(routing.ENDS)
    kept = routing.run(r, lambda s: s, lambda s: s.checkpoint()).where("next_route = 'clarify'").collect()
    assert [x.intent for x in kept] == ["safety_check"]


def test_guard_reads_named_tables_alone(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "k string, v int").createOrReplaceTempView("facts_view")
    spark.range(1).write.parquet(str(tmp_path / "p"))
    ok = guarded_sql.run(spark, "select k from facts_view where v in (select max(v) from facts_view)")
    assert [r.k for r in ok.collect()] == ["a"]
    for bad in (f"select * from parquet.`{tmp_path}/p`", "select reflect('java.lang.System', 'getenv') from facts_view", "select * from other_table", "select java_method('java.lang.Math', 'random')", "select * from range(9)"):
        with pytest.raises(guarded_sql.RefusedSql):
            guarded_sql.run(spark, bad)


def test_guarded_answer(spark):
    spark.createDataFrame([("Red apple", '{"a": 1}')], "name string, j string").createOrReplaceTempView("foods_view")
    fixed = guarded_sql.answer(spark, "q", lambda q: "select nam from foods_view", lambda q, sql, e: "select name from foods_view where name = 'apple'")
    assert fixed["status"] == "success" and [r.name for r in fixed["rows"]] == ["Red apple"] and "ILIKE" in fixed["sql"]
    assert guarded_sql.answer(spark, "q", lambda q: "select nam from foods_view")["reason"] == "schema_mismatch"
    assert guarded_sql.answer(spark, "q", lambda q: "select name from foods_view where name = 'zzz'")["status"] == "empty"
    d = guarded_sql.decoded(spark.table("foods_view")).select(F.try_variant_get("j", "$.a", "int").alias("a"), F.try_variant_get("name", "$", "string").alias("n")).first()
    assert d.a == 1
    assert guarded_sql.structured(spark.createDataFrame([("s", "p", "o")], "subject string, predicate string, object string")).first()[:3] == ("s", "p", "o")


def test_examples(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    p.write_text("﻿" + json.dumps({"query": " q ", "answer": "a", "reference": "g", "citations": "1, 2", "contexts": ["x", ""], "planned_routes": "semantic"}) + "\n\n" + json.dumps({"question": "r", "answer": "b", "citations": [3], "turn_index": 2}) + "\n")
    a, b = records.read_examples(spark, str(p)).collect()
    assert (a.question, a.ground_truth, a.citations, a.contexts, a.actual_routes) == ("q", "g", [1, 2], ["x"], ["semantic"]) and (b.citations, b.turn_index, b.contexts) == ([3], 2, [])
    p.write_text('{"question": "q", "answer": "a"}\n\n{"question": "q"}\n')
    with pytest.raises(Exception, match="line 3: missing required field: answer"):
        records.read_examples(spark, str(p)).collect()
    records.save_result(spark.createDataFrame([("m", 0.5)], "metric string, mean double"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().mean == 0.5


def test_documents_of_files(spark, tmp_path):
    (tmp_path / "b.md").write_text("# Guide\n\n高血压患者禁忌高盐饮食")
    (tmp_path / "a.txt").write_bytes(b"x \xff")
    files = records.read_directory(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["a.txt", "b.md"] and {r.error for r in files.collect()} == {None}
    assert {r.category for r in imports.parsed_files(files).where("path like '%b.md'").collect()} == {"medical"}
    d = records.read_document(spark, str(tmp_path / "b.md")).first()
    assert d.title == "Guide" and imports.inline_text(spark, "a\n\nb").first().body == "a\n\nb"


def test_ids_follow_the_order(spark):
    d = spark.createDataFrame([(k,) for k in (5, 900, 70, 71, 100_000)], "k long")
    assert {r.k: r.id for r in imports.with_ids(d, "k", "id", 10, 64).collect()} == {5: 11, 70: 12, 71: 13, 900: 14, 100_000: 15}


def test_trimmed(spark):
    assert one(spark, lambda c: memory.trimmed(c, 5), "a" * 20 + "\nbb\ncc") == "bb\ncc"
    assert one(spark, lambda c: memory.trimmed(c, 5), "a\n" + "b" * 50) == "b" * 50 and one(spark, lambda c: memory.trimmed(c, 5), "short") == "short"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert blocks.line_blocks(empty, "doc_id", "text").count() == 0 and classes.classified(empty, "text").count() == 0
    assert facts.merge_facts(facts.extract_facts(empty, "doc_id", "text"), "doc_id").count() == 0
    turns = spark.createDataFrame([], "s long, t long, question string, answer string")
    assert evaluation.session_scores(turns, "s", "t", "question", "answer").count() == 0
    log = spark.createDataFrame([], "user_id string, seq long, field string, key string, value string, op string")
    assert memory.profiles(log).count() == 0


def test_one_turn_has_nothing_to_check(spark):
    t = spark.createDataFrame([(1, 0, "那它呢", "热量 5 g")], "s long, t long, question string, answer string")
    assert tuple(evaluation.session_scores(t, "s", "t", "question", "answer").first()) == (1, 1.0, 1.0, 1.0)


def test_bm25_of_query_terms_and_of_other_statistics(spark):
    from quillspark.operators import retrieval

    docs = spark.createDataFrame([(1, "red apple red"), (2, "green apple"), (3, None)], "id int, text string")
    terms = spark.createDataFrame([("red",), ("blue",)], "token string")
    every = {(r.id, r.token): r.weight for r in retrieval.bm25(docs, "id", "text").collect()}
    assert {(r.id, r.token): r.weight for r in retrieval.bm25(docs, "id", "text", terms=terms).collect()} == {k: v for k, v in every.items() if k[1] == "red"}
    other = {(r.id, r.token): r.weight for r in retrieval.bm25(docs, "id", "text", stats=spark.createDataFrame([("apple", 3)], "token string, df long")).collect()}
    # df 1 where the statistics lack a token; apple, in all three documents, weighs less than of this corpus
    assert other[1, "red"] == pytest.approx(every[1, "red"]) and other[2, "apple"] < every[2, "apple"]
