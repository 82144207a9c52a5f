"""Plans and results of steps that grew faster than their input."""

from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import agent_search, blocks, chunks, classes, evaluation, facts, graph, retrieval, routing, sparse_index, text, vector_index


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lexical_f1_stays_in_the_row(spark):
    rows = [(1, "a b b c", "b b b a"), (2, "ab a", "a ab_1 ab"), (3, "", "x"), (4, None, "x"), (5, "番茄 番", "番 番 番"), (6, "x", "y")]
    df = evaluation.lexical_f1(spark.createDataFrame(rows, "k long, a string, b string"), ["k"], "a", "b")
    assert "Generate" not in plan(df) and "Aggregate" not in plan(df)

    def f1(a, b):
        x, y = (Counter(spark.createDataFrame([(t,)], "t string").select(evaluation.lexical_tokens(F.col("t"))).first()[0]) for t in (a, b))
        return 2 * sum((x & y).values()) / (x.total() + y.total()) if x and y else 0.0

    assert {r[0]: r[1] for r in df.collect()} == {k: f1(a, b) for k, a, b in rows}


def test_context_use_of_a_long_conversation(spark, tmp_path):
    from quillspark.plans.answers import e5_context_use

    turns = [(0, i, "user", f"w{i // 3} w{i % 5} x") for i in range(400)] + [(1, 7, "user", "a"), (1, 9, "user", "a b"), (1, 12, "user", "a"), (2, None, "user", "a")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = e5_context_use(spark, str(tmp_path))
    assert "span" in plan(df)  # a join by conversation alone compares 400 * 400 turns
    found = {(r[0], r[1]): r[2] for r in df.collect()}

    def best(c, t):
        own = Counter(next(x[3] for x in turns if x[:2] == (c, t)).split())
        others = [Counter(x[3].split()) for x in turns if x[0] == c and x[1] is not None and x[1] != t and abs(x[1] - t) <= 2]
        return round(max(2 * sum((own & o).values()) / (own.total() + o.total()) for o in others), 6) if others else None

    want = {(c, t): best(c, t) for c, t, *_ in turns if t is not None}
    assert found == {k: v for k, v in want.items() if v is not None}


def test_garbled_characters_are_those_outside_valid(spark):
    c = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert c.where(~F.col("c").eqNullSafe(F.regexp_replace("c", text.GARBLED, "")) != F.col("c").rlike("[^" + text.VALID[1:])).count() == 0
    # one class test for one-byte characters: no ranges of them are left in the pattern
    assert "a-z" not in text.GARBLED and "0-9" not in text.GARBLED


def test_relations_of_requests_broadcast_no_rows_of_requests(spark):
    t = spark.createDataFrame([(f"c{i}", "located_in", f"n{i % 3}", 0.5) for i in range(30)], "subject string, predicate string, object string, confidence double")
    r = spark.createDataFrame([(i, e) for i in range(30) for e in (f"c{i}", f"n{i % 3}")], "request long, entity string")
    df = graph.relations_of_requests(t, r, ("located_in",))
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()  # files of requests are far smaller than their rows
    assert df.where("hop = 0").count() == 300


def test_sparse_search_writes_no_pairs_of_query_and_document(spark, monkeypatch):
    index = sparse_index.create(spark)
    docs = spark.createDataFrame([(i, f"a b {'c' * (i % 4 + 1)}") for i in range(50)], "id long, text string")
    sparse_index.add(index, docs, "id", "text")

    def no(df):
        raise AssertionError("a table of candidates")

    monkeypatch.setattr(sparse_index, "cut", no)
    monkeypatch.setattr(sparse_index, "QUERY_ROWS", 7, raising=False)
    monkeypatch.setattr(sparse_index, "DOC_ROWS", 8, raising=False)
    found = sparse_index.search(index, docs, "id", "text", 3)
    same = {r: [x for x in range(50) if x % 4 == r][:3] for r in range(4)}
    assert {q: [r.doc for r in sorted(found.where(f"query = {q}").collect(), key=lambda r: r["rank"])] for q in (0, 5, 49)} == {q: same[q % 4] for q in (0, 5, 49)}


def test_term_counts(spark):
    df = spark.createDataFrame([("b A b 番茄 b",), ("",), (None,)], "t string").select(retrieval.term_counts(F.col("t")).alias("c"))
    assert [[tuple(x) for x in r.c] for r in df.collect()] == [[("a", 1), ("b", 3), ("番", 1), ("番茄", 1), ("茄", 1)], [], []]


def test_bm25_and_vectors_count_within_the_row(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b 番茄")], "id long, text string")
    assert "Aggregate" not in plan(retrieval.hashed_dense(docs, "id", "text"))
    # texts are tokenised once, before the plan of the weights
    assert "regexp_extract_all" not in plan(retrieval.bm25(docs, "id", "text"))
    assert {(r.id, r.token) for r in retrieval.bm25(docs, "id", "text").collect()} == {(1, "a"), (1, "b"), (3, "b"), (3, "番"), (3, "茄"), (3, "番茄")}


def test_equal_requests_are_run_once(spark, monkeypatch):
    kinds = [("general", "a", ["x"], ["semantic"]), ("general", None, ["x"], ["semantic"]), ("general", "a", [], ["semantic"])]
    r = spark.createDataFrame([(i, *kinds[i % 3]) for i in range(60)], "request_id long, intent string, query string, entities array<string>, planned array<string>")
    ran = []

    def run(requests, retrieve, cut):
        states = routing.start(requests)
        ran.append(states.count())
        return cut(states.withColumn("entities", F.array(F.lit("new"))))

    class Found:
        retrieve = None

    monkeypatch.setattr(agent_search.routing, "run", run)
    out = agent_search.run(r, Found())
    assert ran == [3]
    assert sorted((x.request_id, x.query, x.entities) for x in out.fillna("-", ["query"]).collect()) == [(i, kinds[i % 3][1] or "-", ["new"]) for i in range(60)]
    assert agent_search.run(r, Found(), {"steps": F.col("steps") + 1}).columns == ["request_id", "steps"]


def test_few_queries_scan_the_index_without_a_shuffle_of_its_rows(spark):
    v = spark.createDataFrame([(i, [float(i * i % 17), float(i % 5), 1.0]) for i in range(200)] + [(300, None)], "id long, v array<double>")
    q = spark.createDataFrame([(0, [3.0, 1.0, 1.0]), (1, [0.0, 0.0, 0.0]), (2, [1.0]), (3, None)], "id long, v array<double>")
    for metric in ("l2", "cosine"):
        index = vector_index.build(v, "id", "v", metric, cells=5)
        few, cells = (f(index, q, "id", "v", 7, **kw).collect() for f, kw in ((vector_index.scan, {}), (vector_index.search, {"exact": True})))
        assert sorted(few) == sorted(cells) and few
    assert "CoGroup" not in plan(vector_index.scan(index, q, "id", "v", 7))


def test_dense_vectors_hold_every_component(spark):
    d = spark.createDataFrame([(1, "a b b 番茄"), (2, ""), (3, None), (4, "x")], "id long, text string")
    got = {r.id: list(r.vector) for r in agent_search.dense_vectors(d, "id", "text").collect()}
    want = {}
    for r in retrieval.hashed_dense(d, "id", "text").collect():
        want.setdefault(r.id, [0.0] * 384)[r.idx] = r.value
    assert got == want and set(got) == {1, 4}
    assert "Aggregate" not in plan(agent_search.dense_vectors(d, "id", "text"))


def test_blocks_and_chunks_evaluate_each_step_once(spark):
    d = spark.createDataFrame([(1, "# a\n- b")], "id long, text string").withColumn("blocks", blocks.block_list(F.col("text")))
    assert plan(d).count(blocks.TABLE) == 1
    b, label = F.col("blocks"), F.lit("x")
    # a pattern or a term of each chunker, and how often it is needed
    for made, mark, times in ((chunks.recipe_chunks(b, label, label), "步?骤?", 2 * 2), (chunks.daily_chunks(b, label), "[0-9]{8}", 1), (chunks.personal_chunks(b, label, label), "不耐受", 1), (chunks.medical_chunks(b, label, label), "不可", 1)):
        assert plan(spark.createDataFrame([], "blocks array<struct<kind:string,content:string>>").select(made.alias("c"))).count(mark) <= times


def test_strip_takes_what_the_pattern_takes(spark):
    chars = [chr(c) for c in (*range(1, 40), 0x85, 0xA0, 0x3000, 0x2028)]
    rows = [(a + b + "x" + b + a,) for a in chars for b in chars] + [("",), (" \n",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert df.where(~blocks.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?d)^\s+|\s+$", ""))).count() == 0


def test_terms_are_looked_up_before_patterns_and_replacements(spark):
    df = spark.createDataFrame([("aXa番茄番",), ("",), (None,), ("番番番",)], "t string")
    assert [tuple(r) for r in df.select(text.occurrences(F.col("t"), "番"), text.occurrences(F.col("t"), "a")).collect()] == [(2, 2), (0, 0), (None, None), (3, 0)]
    assert "Contains" in str(df.select(text.occurrences(F.col("t"), "番"))._jdf.queryExecution().optimizedPlan().toString()).replace("contains", "Contains")
    # a sign stands in every match, as each alternative of the pattern holds one
    samples = ["步骤 1", "第 2 步", "3. 加入", "4、炒", "姓名，年龄", "BMI 体重", "药物", "肾病", "1. 用", "plain 1. text", ""]
    d = spark.createDataFrame([(s,) for s in samples], "t string")
    plain = F.coalesce(*(F.when(F.col("t").rlike(p), k) for k, p in classes.STRONG.items()))
    assert d.where(~classes.strong_category(F.col("t")).eqNullSafe(plain)).count() == 0
    assert plan(d.select(classes.strong_category(F.col("t")))).lower().count("contains") >= 20


def test_image_routes_squeeze_a_text_once(spark):
    from quillspark.sources import records

    df = spark.createDataFrame([("x.bmp", 10, "能量\t 蛋白质 \n\n脂肪  " + "字 " * 20), ("x.bmp", 10, " \n "), ("x.bmp", None, None), ("食谱.png", 10, "能量"), ("fridge.jpg", 10, "能量  "), ("x.bmp", 10, "a b\r\nc " * 6)], "name string, size long, t string")
    r = df.select(records.image_route(F.col("name"), F.col("size"), F.col("t")).alias("r")).select("r.kind", "r.subtype", F.round("r.confidence", 6), "r.decision", "r.reason")
    assert plan(r).count("regexp_replace") == 1
    assert [tuple(x)[1:5] for x in r.collect()] == [
        ("nutrition_table", 0.93, "direct_document", "ocr_strong_document_match"),
        ("pdf_page", 0.55, "vision_required", "weak_small_file_document_hint"),
        ("unknown", 0.0, "vision_required", "stat_failed"),
        ("recipe", 0.9, "direct_document", "filename_strong_document_match"),
        ("nutrition_table", 0.64, "vision_required", "ocr_weak_document_hint"),
        ("pdf_page", 0.7, "vision_required", "ocr_weak_document_hint"),
    ]


def test_facts_look_for_each_pattern_once(spark):
    texts = [(1, "番茄含蛋白质 0.9g，蛋白质 3克，碳水化合物 3.3 G，适合减脂 。高蛋白低脂"), (2, "每 100 克"), (3, "鱼每 100 克，热量 15 KCAL，适合 \n"), (4, None), (5, "低碳水营养 脂肪1克"), (6, "豆腐营养")]
    df = facts.extract_facts(spark.createDataFrame(texts, "k long, t string"), "k", "t")
    assert plan(df).count(facts.ENTITY[0]) == 1
    assert sorted(map(tuple, df.collect())) == [
        (1, "番茄", 0, "protein", "0.9g", 0.9),
        (1, "番茄", 1, "carbs", "3.3G", 0.9),
        (1, "番茄", 2, "suitable_for", "减脂", 0.75),
        (1, "番茄", 3, "dietary_feature", "高蛋白", 0.75),
        (1, "番茄", 4, "dietary_feature", "低脂", 0.75),
        (3, "鱼", 0, "calories", "15KCAL", 0.9),
        (3, "鱼", 1, "suitable_for", "", 0.75),
    ]


def test_clauses_and_blocks_run_patterns_only_where_marks_stand(spark):
    ends = ["", " ", "\t", "\x0b", "\f", "\r", " \t\x0b"]
    texts = [f"{a}{t}{b}" for a in ends for b in ends for t in ("one two", "一，而且二；三", "a\nb", "句。\n和，与：", "x" * 900, "和，" * 300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, t string")
    for r in df.select("t", chunks.clause_parts(F.col("t")).alias("p"), chunks.sentence_list(F.col("t")).alias("s")).collect():
        assert r.p == chunks.split_by_clauses(r.t) and r.s == chunks.sentences(r.t), r.t
    # no pattern is run over whole texts to join lines to blocks
    joined = df.select(blocks.islands(F.split("t", "\n"), F.transform(F.split("t", "\n"), lambda x: x == "b")).alias("v"))
    assert "regexp_replace" not in joined._jdf.queryExecution().optimizedPlan().toString() and joined.where("array_contains(v, 'b')").count() == len(ends)
    lines = ["| a | b |", " | a |", "|-|", "# h", "#h", " # h", "- x", " \x0b* y", "-", "+ ", "\t", "", "\x0b\f", "plain", "*bold*"]
    found = spark.createDataFrame([(i, x + "\n" + x) for i, x in enumerate(lines)], "id int, t string").select("id", blocks.block_list(F.col("t")).alias("b")).collect()
    kinds = {lines[r.id]: [b.kind for b in r.b] for r in found}
    assert kinds == {"| a | b |": ["table"], " | a |": ["text"], "|-|": ["table"], "# h": ["text", "text"], "#h": ["text"], " # h": ["text"], "- x": ["list"], " \x0b* y": ["list"], "-": ["text"], "+ ": ["text"], "\t": [], "": [], "\x0b\f": [], "plain": ["text"], "*bold*": ["text"]}
