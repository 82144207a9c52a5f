"""A run of the router over indexes, against a run whose evidence plain loops find in the same texts."""

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import agent_search, chunks, planning, retrieval, routing

NOTES = [
    "番茄 鸡蛋 一起吃 营养 丰富，适合 早餐。", "痛风 患者 不宜 吃 虾 和 动物内脏，嘌呤 高。", "糖尿病 患者 控制 碳水 和 糖 的 摄入。", "高血压 少吃 钠，多吃 菠菜 香蕉。", "牛奶 含 蛋白质 和 钙。",
    "豆腐 的 做法：切块 煎 黄。", "燕麦 早餐 膳食纤维 丰富。", "鱼 和 鸡肉 是 优质 蛋白质。", "苹果 每天 一个。", "hello world plain english text", "番茄 炒 鸡蛋 的 做法", "米饭 热量 不低", "虾 过敏 要 避免 虾 制品", "花生 过敏 风险", "牛肉 补铁",
]
TRIPLES = [("痛风", "contraindicated_for", "虾", 0.9), ("虾", "contains", "嘌呤", 0.8), ("番茄", "pairs_with", "鸡蛋", 0.7), ("鸡蛋", "contains", "蛋白质", 0.9), ("糖尿病", "recommends", "燕麦", 0.3), ("燕麦", "contains", "膳食纤维", 0.6)]
FACTS = ["番茄", "番茄", "牛奶", "鸡蛋"]
QUESTIONS = ["痛风能吃虾吗", "番茄鸡蛋怎么做", "糖尿病饮食建议", "牛奶的蛋白质含量大于多少", "xyz", "我对花生过敏", "推荐早餐", "蛋白质高的食物"]


def tokens(text):
    cjk = re.findall("[一-鿿]", text)
    return [w.lower() for w in re.findall("[a-zA-Z]+", text)] + [a + b for a, b in zip(cjk, cjk[1:], strict=False)] + cjk


def dense(text):
    v = Counter()
    for t in tokens(text):
        h = hashlib.md5(t.encode()).hexdigest()
        v[int(h[:8], 16) % 384] += 1 - 2 * (int(h[8:10], 16) % 2)
    v = {k: x for k, x in v.items() if x}
    n = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / n for k, x in v.items()}


def semantic(text):
    docs = [tokens(n) for n in NOTES]
    df, avg = Counter(t for d in docs for t in set(d)), max(1.0, sum(map(len, docs)) / len(docs))
    q = Counter(tokens(text))
    sparse = []
    for i, d in enumerate(docs):
        tf = Counter(d)
        s = sum(n / max(q.values()) * math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / avg)) for t, n in q.items() if tf[t])
        sparse += [(-round(s, 6), i)] if s > 0 else []
    sparse = sorted(sparse)[:30]
    v = dense(text)
    near = sorted((round(math.sqrt(sum((v.get(k, 0) - w.get(k, 0)) ** 2 for k in v.keys() | w.keys())), 6), i) for i, w in enumerate(map(dense, NOTES)))[:30] if v else []
    score = Counter()
    for d, i in near:
        score[i] += 0.7 / (1 + d)
    for s, i in sparse:
        score[i] += 0.3 * s / sparse[0][0]
    best = sorted((-round(s, 6), i) for i, s in score.items())[:15]
    names = [n for n in retrieval.DISCOVERABLE if any(n in NOTES[i] for _, i in best[:5])]
    return [-s for s, _ in best], names


def relation(names):
    near = sorted({t for t in TRIPLES if t[0] in names or t[2] in names})[:80]
    expand = ("contraindicated_for", "conflicts_with", "pairs_with", "can_replace", "recommends", "suitable_for")
    other = sorted({x for t in near if t[1] in expand for x in (t[0], t[2])} - set(names))[:5]
    far = [t for t in sorted({t for t in TRIPLES if t[0] in other or t[2] in other})[:30] if t not in near]
    return [" ".join(t[:3]) for t in near + far], [t[3] for t in near + far]


def plain_retrieve(spark):
    """Evidence of each row by the functions above; texts to search for are the operator's own columns."""

    def retrieve(states):
        context = routing.route_context(F.col("intent"), F.col("query"), F.col("entities"), F.array_except("entities", routing.covered(F.col("entities"), F.col("relation_texts"))))
        out = []
        for r in states.withColumn("ctx", context).collect():
            d = r.asDict()
            ctx = d.pop("ctx")
            if r.next_route == "semantic":
                text = ctx["expanded_query"] if r.semantic_retries > 0 else ctx["semantic_query"] if r.errors else r.query
                scores, names = semantic(text)
                d |= {"semantic": scores, "discovered": [n for n in names if n not in r.entities][:8] if scores else []}
            if r.next_route == "relation":
                d["relation_texts"], d["relation_scores"] = relation(r.entities)
            if r.next_route == "text2sql":
                d["sql_rows"] = min(50, sum(f in r.entities for f in FACTS))
            out.append(tuple(d[c] for c in states.columns))
        return spark.createDataFrame(out, states.schema)

    return retrieve


def test_run_over_indexes_equals_plain_loops(spark):
    r = spark.createDataFrame(list(enumerate(QUESTIONS * 2)), "request_id long, query string").withColumn("p", planning.fallback_plan(F.col("query")))
    r = r.select("request_id", "query", "p.intent", F.transform(planning.entities(F.col("query")), lambda x: x["name"]).alias("entities"), F.col("p.routes").alias("planned"))
    notes = spark.createDataFrame(list(enumerate(NOTES)), "doc long, text string")
    searcher = agent_search.Searcher.over(notes, spark.createDataFrame(TRIPLES, "subject string, predicate string, object string, confidence double"), spark.createDataFrame([(f,) for f in FACTS], "entity string"), cells=4)
    got = {x.request_id: x for x in agent_search.run(r, searcher).collect()}
    want = {x.request_id: x for x in routing.run(r, plain_retrieve(spark)).collect()}
    plain = lambda row: {k: [round(x, 5) if isinstance(x, float) else x for x in v] if isinstance(v, list) else v for k, v in row.asDict().items()}
    assert {k: plain(v) for k, v in got.items()} == {k: plain(v) for k, v in want.items()}
    assert {x.next_route for x in got.values()} >= {"rerank"} and any("relation" in x.executed for x in got.values())
    assert all(len(t) <= 4 for t in searcher.found.values())  # equal searches are made once


def test_folds_equal_those_of_one_text(spark):
    import random

    r = random.Random(1)
    words = ["番茄", "鸡蛋", "run fast", "the of", "但是", "，", "、", "或", " ", "x", "跑步", "。", "！", "；", "\n", "："]

    def text():
        return "".join("".join(r.choice([*words, "好" * r.randint(1, 200)]) for _ in range(r.randint(1, 30))) + r.choice(["。", "，", "\n", ""]) for _ in range(r.randint(0, 60)))

    texts = dict(enumerate([text() for _ in range(80)] + ["", None, "x", "。", "好" * 3000, "好" * 3000 + "。" + "好" * 3000]))
    found = spark.createDataFrame(list(texts.items()), "i int, t string").select("i", chunks.similarity_parts(F.col("t")).alias("a"), chunks.clause_parts(F.col("t")).alias("b")).collect()
    for x in found:
        assert x.a == chunks.split_by_similarity(texts[x.i] or "") and x.b == chunks.split_by_clauses(texts[x.i] or "")
