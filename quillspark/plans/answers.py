"""Queries of evidence and evaluation over the events and conversations, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import evidence as A
from ..sources.samples import QUESTIONS, REQUESTS_SQL, pick, requests, sql_list, sql_text
from ..sources.tables import table
from .agent import _any, _csv
from .records import LEX

PER = 12  # pieces of evidence of a request
SPAN = 8  # turns of a conversation that are joined at once
TEXTS = ("番茄富含维生素，适合凉拌。", "番茄富含维生素，适合凉拌！", "花生含有脂肪", "", "每百克鸡蛋含蛋白质十三克", "the quick brown fox jumps over the lazy dog")
PREDICATES = ("含有", "相克", "pairs_with")
INTENTS = ("diet_advice", "disease_diet", "safety_check", "general")
ROUTES = ("semantic", "relation", "text2sql")
ALLERGIES = ("花生", "fox", "虾")
TYPES = tuple(A.CONTENT_WORDS)


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    request = F.floor(n / PER).cast("long")
    kind = n % 3
    null = F.lit(None).cast("string")
    doc = F.when(n % 5 == 0, F.concat_ws(":", F.lit("user_content"), (n % 4).cast("string"), pick(TYPES, n), F.lit("x")))
    meta = F.when(n % 7 == 0, F.create_map(F.lit("source_type"), F.lit("user_saved_content"), F.lit("user_id"), (n % 4).cast("string"), F.lit("user_content_type"), F.lit("food_log")))
    return table(spark, sf, "events").select(
        request.alias("request"), n.alias("key"), pick(QUESTIONS, request).alias("query"), pick(INTENTS, request).alias("intent"), (request % 4).cast("string").alias("user_id"), pick(ROUTES, kind).alias("source_type"),
        F.when(kind != 1, F.round(F.col("value") / 100, 6)).alias("score"), F.when(kind == 0, pick(TEXTS, n)).alias("content"), F.when(kind == 1, "番茄").alias("subject"), F.when(kind == 1, pick(PREDICATES, F.floor(n / 3))).alias("predicate"), F.when(kind == 1, pick(TEXTS, n)).alias("object"),
        F.when(kind == 2, "鸡蛋").alias("entity"), F.when(kind == 2, "热量").alias("attribute"), F.when(kind == 2, F.col("event_type")).alias("value"), doc.alias("source_doc_id"), meta.alias("metadata"), F.when(n % 2 == 0, n.cast("string")).otherwise(null).alias("chunk_id"),
    )


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return A.rerank(_evidence(spark, sf), "request")


def a2_policy(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).withColumn("p", A.policy(F.col("query"))).select("request_id", "p.mode", "p.required", F.array_join("p.types", ",").alias("types"))


def a3_a4_content_weight(spark: SparkSession, sf: str) -> DataFrame:
    e = _evidence(spark, sf).withColumns({"own": A.owner(F.col("source_doc_id"), F.col("metadata")), "p": A.policy(F.col("query"))})
    return e.select("key", "own.user_id", "own.content_type", A.visible(F.col("own"), F.col("user_id")).alias("visible"), A.content_weight(F.col("own"), F.col("p"), F.col("intent"), F.col("query")).alias("weight")).withColumnRenamed("user_id", "owner")


def a6_a8_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select("request", "key", "rank", F.round("rerank_score", 10).alias("score"), "mode", "status")


def a7_evidence_text(spark: SparkSession, sf: str) -> DataFrame:
    e = _evidence(spark, sf)
    item = F.struct("content", "subject", "predicate", "object", "value")
    return e.select("key", A.evidence_text(item).alias("text"))


def a9_flag_for_user(spark: SparkSession, sf: str) -> DataFrame:
    r = _ranked(spark, sf).withColumn("text", F.coalesce(F.nullif("content", F.lit("")), F.concat("subject", "predicate", "object"), "value")).withColumn("allergies", F.when(F.col("request") % 3 > 0, F.array(*map(F.lit, ALLERGIES))))
    f = A.flag_for_user(r, "request", "text", "rerank_score", "allergies")
    return f.select("request", "key", F.array_join("hits", ",").alias("hits"), "snippet", F.round("rerank_score", 10).alias("score"))


def a10_a13_blocks(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct("source_type", "content", "subject", "predicate", "object", "entity", "attribute", "value", F.lit(None).cast("string").alias("evidence_id"), "chunk_id", F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("id"))
    score = F.round(F.col("score") + 0.00011, 6)
    return _evidence(spark, sf).select("key", A.block_of(F.col("key"), item, score).alias("block"), A.context_id(item, F.col("key") * 2).alias("context_id"), A.context_text(item).alias("context"))


def a11_cited(spark: SparkSession, sf: str) -> DataFrame:
    e = _evidence(spark, sf).withColumn("rank", (F.col("key") % PER + 1).cast("int"))
    answers = e.select("request").distinct().withColumn("answer", F.concat(F.lit("a[来源2] b[证据1]c[来源2][来源99] [来源"), (F.col("request") % PER).cast("string"), F.lit("]")))
    return A.cited(answers, e, "request", "answer")


def a12_missing_answer(spark: SparkSession, sf: str) -> DataFrame:
    r = requests(spark, sf).withColumn("p", A.policy(F.col("query")))
    return r.select("request_id", A.missing_answer(F.col("p"), F.col("n") % 2 == 0).alias("answer")).where("answer is not null")


def a14_summaries(spark: SparkSession, sf: str) -> DataFrame:
    e = _evidence(spark, sf).withColumns({"rank": (F.col("key") % PER + 1).cast("int"), "rerank_score": F.col("score")})
    return A.summaries(e, "request").withColumn("recent", F.array_join(A.recent(F.transform(F.sequence(F.lit(1).cast("long"), F.col("chunk_id") % 30 + 1), lambda i: i.cast("string")), 20), ",")).select("request", "rank", "source_type", "chunk_id", "preview", "recent")


def _list(options, n, size):
    """An array of `size` of options, from the n-th on, around."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(1).cast("long"), size), lambda i: pick(options, n + i * 7))).otherwise(F.array().cast("array<string>"))


def _sql_pick_list(options, n, size) -> str:
    return f"list_transform(range(1, {size} + 1), lambda i: {sql_list(options)}[({n} + i * 7) % {len(options)} + 1])"


NAMES = ("番茄", "鸡蛋", "牛奶", "semantic", "relation")
SAID = ("请咨询医生或营养师。", "历史问答参考：番茄 100 kcal", "花生很好", "热量 100 kcal, 蛋白质 3 g", "虾")


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf, "events").select(
        n, pick(("disease_diet", "medical", "general"), n).alias("intent"), F.when(n % 4 > 0, pick(("disease_diet", "medical", "general"), F.floor(n / 3))).otherwise("").alias("expected_intent"), F.concat(pick(SAID, n), pick(SAID, F.floor(n / 5))).alias("answer"),
        _list(NAMES, n, n % 4).alias("a"), _list(NAMES, F.floor(n / 4), F.floor(n / 4) % 4).alias("b"), F.transform(F.sequence(F.lit(1).cast("long"), n % 3 + 1), lambda i: ((n + i * 5) % 6).cast("int")).alias("citations"), (n % 5).cast("int").alias("n_contexts"), _list(ALLERGIES, n, n % 2).alias("allergies"), _list(SAID, n, F.floor(n / 7) % 2).alias("restrictions"), F.when(n % 3 == 0, F.array(F.lit("context_only"))).otherwise(F.array().cast("array<string>")).alias("policies"),
    )


def e2_e3_planner_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = _examples(spark, sf).withColumns({"p": E.planner_scores(F.col("expected_intent"), F.col("intent"), F.col("a"), F.col("b")), "c": E.citation_scores(F.col("citations"), F.col("n_contexts"))})
    return x.select("event_id", "p.intent_accuracy", *(F.round(f"p.{k}", 6).alias(k) for k in ("route_precision", "route_recall", "route_f1")), *(F.round(f"c.{k}", 6).alias(k) for k in ("validity", "coverage")))


def e6_e8_safety_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = _examples(spark, sf).withColumns({"s": E.safety_scores(F.col("intent"), F.col("answer"), F.col("allergies"), F.col("restrictions"), F.col("a")), "m": E.memory_scores(F.col("answer"), F.col("policies"))})
    return x.select("event_id", "s.*", "m.*")


def e9_e11_route_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = _examples(spark, sf).withColumns({"d": E.discovery_scores(F.col("a"), F.col("b")), "f": E.filter_scores(F.col("a"), F.col("b")), "r": E.dynamic_route_scores(F.col("a"), F.col("b"))})
    return x.select("event_id", F.round(E.route_order(F.col("a"), F.col("b")), 6).alias("route_order"), *(F.round(f"d.{k}", 6).alias(f"entity_{k}") for k in ("precision", "recall")), *(F.round(f"r.{k}", 6).alias(f"route_{k}") for k in ("precision", "recall")), *(F.round(f"f.{k}", 6).alias(f"filter_{k}") for k in ("precision", "recall", "false_positive")))


def e14_e21_examples(spark: SparkSession, sf: str) -> DataFrame:
    x = _examples(spark, sf)
    agent = E.run_agent(x, lambda d: d.withColumn("response", F.struct(F.col("a").alias("executed_routes"), F.col("b").alias("fallback_routes"), F.col("answer").alias("answer"))))
    dynamic = E.dynamic_routes(F.col("response.executed_routes"), F.col("response.fallback_routes"), F.array(F.lit("semantic"), F.lit("answer")))
    return agent.select("event_id", F.array_join(dynamic, ",").alias("dynamic_routes"), F.md5("response.answer").alias("answer_md5"))


def e5_context_use(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    # turns meet in spans of SPAN, an answer in those of the turns two before and two after it, so a long conversation is no square
    near = F.array_distinct(F.array(*(F.floor((F.col("turn") + d) / SPAN) for d in (-2, 2))))
    contexts = c.select("conv_id", F.floor(F.col("turn") / SPAN).alias("span"), F.col("turn").alias("other"), F.col("text").alias("context"))
    pairs = c.select("conv_id", "turn", "text", F.explode(near).alias("span")).join(contexts, ["conv_id", "span"]).where("other <> turn and abs(other - turn) <= 2")
    return E.context_use(pairs, ["conv_id", "turn"], "other", "text", "context").select("conv_id", "turn", F.round("context_utilization", 6).alias("context_utilization"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("turn") + F.col("conv_id")
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", pick(("那它呢", "番茄", "这个 good?"), n).alias("question"), F.concat_ws(" ", pick(("热量 100 kcal", "热量 200 kcal 蛋白质是3g", "蛋白质 3 mg 约含 5 g", "alpha beta"), F.floor(n / 2)), "text").alias("answer"))


def e15_e20_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = E.session_scores(_turns(spark, sf), "conv_id", "turn", "question", "answer")
    return s.select("conv_id", *(F.round(k, 6).alias(k) for k in ("pronoun_resolution", "factual_consistency", "info_repetition")))


OWN_USER = "CASE WHEN key % 5 = 0 THEN (key % 4)::varchar WHEN key % 7 = 0 THEN (key % 4)::varchar END"
OWN_TYPE = f"CASE WHEN key % 5 = 0 THEN {sql_list(TYPES)}[key % {len(TYPES)} + 1] WHEN key % 7 = 0 THEN 'food_log' END"
EVIDENCE = f"""ev AS (SELECT event_id // {PER} AS request, event_id AS key, {sql_list(QUESTIONS)}[event_id // {PER} % {len(QUESTIONS)} + 1] AS query, {sql_list(INTENTS)}[event_id // {PER} % {len(INTENTS)} + 1] AS intent, (event_id // {PER} % 4)::varchar AS user_id, {sql_list(ROUTES)}[event_id % 3 + 1] AS source_type,
 CASE WHEN event_id % 3 <> 1 THEN round(value / 100, 6) END AS score, CASE WHEN event_id % 3 = 0 THEN {sql_list(TEXTS)}[event_id % {len(TEXTS)} + 1] END AS content, CASE WHEN event_id % 3 = 1 THEN '番茄' END AS subject, CASE WHEN event_id % 3 = 1 THEN {sql_list(PREDICATES)}[event_id // 3 % {len(PREDICATES)} + 1] END AS predicate, CASE WHEN event_id % 3 = 1 THEN {sql_list(TEXTS)}[event_id % {len(TEXTS)} + 1] END AS object, CASE WHEN event_id % 3 = 2 THEN event_type END AS value FROM events)"""


def _policy(col: str) -> str:
    types = "list_filter([" + ", ".join(f"CASE WHEN {_any(col, w)} THEN '{k}' END" for k, w in A.CONTENT_WORDS.items()) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN {_any(col, A.OWNER)} THEN {types} ELSE [] END"


def _mode(col: str, types: str) -> str:
    return f"CASE WHEN len({types}) > 0 OR {_any(f'lower({col})', A.OWN_DATA)} THEN 'strong' WHEN {_any(f'lower({col})', A.PERSONAL)} THEN 'weak' ELSE 'none' END"


TABLE = "CASE " + " ".join(f"WHEN intent = '{i}' AND ctype = '{k}' THEN {w}" for i, ws in A.CONTENT_WEIGHTS.items() for k, w in ws.items()) + " END"
WEIGHTED = f"""{EVIDENCE}, e1 AS (SELECT *, {OWN_USER} AS owner, {OWN_TYPE} AS ctype, {_policy('query')} AS types0 FROM ev), e2 AS (SELECT *, {_mode('query', 'types0')} AS mode FROM e1), e3 AS (SELECT *, mode = 'strong' AS required, CASE WHEN mode = 'strong' THEN types0 ELSE [] END AS types FROM e2),
e4 AS (SELECT *, (CASE WHEN owner IS NULL THEN 1.0 WHEN required AND (len(types) = 0 OR list_contains(types, ctype)) THEN 10.0 WHEN required THEN 2.0 ELSE coalesce({TABLE}, CASE WHEN {_any('lower(query)', A.PERSONAL)} THEN 1.1 ELSE 1.0 END) END)::double AS weight FROM e3)"""
SENTENCE = "CASE predicate " + " ".join(f"WHEN '{k}' THEN replace(replace({sql_text(v)}, '{{s}}', subject), '{{o}}', object)" for k, v in A.SENTENCES.items()) + " ELSE subject || predicate || object END"
GRAMS = "list_distinct(list_transform(range(1, greatest(length(coalesce({c}, '')) - 1, 0) + 1), lambda i: substr({c}, i, 2)))"
RANKED = f"""{WEIGHTED}, o AS (SELECT *, list_position({sql_list(ROUTES)}, source_type) AS ord, coalesce(score, 0) * CASE source_type WHEN 'text2sql' THEN 1.15::double WHEN 'relation' THEN 1.05::double ELSE 0.95::double END * weight AS rs FROM e4 WHERE owner IS NULL OR owner = user_id),
seq AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY ord, key) AS i, CASE WHEN predicate IS NOT NULL THEN subject || '|' || predicate || '|' || object END AS tk, CASE WHEN predicate IS NULL THEN {GRAMS.format(c='content')} ELSE []::varchar[] END AS g FROM o),
dup AS (SELECT b.request, b.i AS i, a.i AS j FROM seq a JOIN seq b ON a.request = b.request AND a.i < b.i AND (a.tk = b.tk OR (b.tk IS NULL AND len(a.g) > 0 AND len(b.g) > 0 AND len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::double >= 0.85))),
dl AS (SELECT s.request, s.i, coalesce(list(d.j) FILTER (WHERE d.j IS NOT NULL), []) AS js FROM seq s LEFT JOIN dup d ON s.request = d.request AND s.i = d.i GROUP BY ALL),
fold AS (SELECT request, 1 AS i, [1]::bigint[] AS kept FROM dl WHERE i = 1 UNION ALL SELECT f.request, f.i + 1, CASE WHEN list_has_any(f.kept, d.js) THEN f.kept ELSE list_append(f.kept, d.i) END FROM fold f JOIN dl d ON d.request = f.request AND d.i = f.i + 1),
last AS (SELECT request, max_by(kept, i) AS kept FROM fold GROUP BY 1),
stay AS (SELECT s.* FROM seq s JOIN last USING (request) WHERE list_contains(kept, s.i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN required AND owner IS NOT NULL THEN 0 ELSE 1 END, rs DESC, ord, key) AS rank, CASE WHEN NOT required THEN 'not_required' WHEN max(CASE WHEN owner IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY request) = 1 THEN 'private_content_found' ELSE 'private_content_missing' END AS status FROM stay)"""


def _examples_sql() -> str:
    three = sql_list(("disease_diet", "medical", "general"))
    return f"""ex AS (SELECT event_id, event_id AS n, {three}[event_id % 3 + 1] AS intent, CASE WHEN event_id % 4 > 0 THEN {three}[event_id // 3 % 3 + 1] ELSE '' END AS expected_intent, {sql_list(SAID)}[event_id % 5 + 1] || {sql_list(SAID)}[event_id // 5 % 5 + 1] AS answer, {_sql_pick_list(NAMES, 'event_id', 'event_id % 4')} AS a, {_sql_pick_list(NAMES, 'event_id // 4', 'event_id // 4 % 4')} AS b, list_transform(range(1, event_id % 3 + 2), lambda i: (event_id + i * 5) % 6) AS citations, event_id % 5 AS nc, {_sql_pick_list(ALLERGIES, 'event_id', 'event_id % 2')} AS allergies, {_sql_pick_list(SAID, 'event_id', 'event_id // 7 % 2')} AS restrictions FROM events),
xs AS (SELECT *, list_distinct(a) AS sa, list_distinct(b) AS sb, len(list_intersect(a, b))::double AS h FROM ex)"""


EX = _examples_sql()
F1 = "CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"
TURNS = f"""tn AS (SELECT conv_id, turn, ['那它呢', '番茄', '这个 good?'][(turn + conv_id) % 3 + 1] AS question, concat_ws(' ', ['热量 100 kcal', '热量 200 kcal 蛋白质是3g', '蛋白质 3 mg 约含 5 g', 'alpha beta'][(turn + conv_id) // 2 % 4 + 1], text) AS answer FROM conversations),
tp AS (SELECT *, lag(answer) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS pt FROM tn)"""
CLAIM = sql_text(E.CLAIM)
SKIP = "(" + ", ".join(f"'{x}'" for x in E.SKIPPED) + ")"
GRAMS10 = "list_distinct(list_transform(range(1, greatest(length({c}) - 9, 0) + 1), lambda i: substr({c}, i, 10)))"
SQL = {
    "a2_policy": f"WITH {REQUESTS_SQL}, t AS (SELECT request_id, query, {_policy('query')} AS types FROM requests), m AS (SELECT *, {_mode('query', 'types')} AS mode FROM t) SELECT request_id, mode, mode = 'strong' AS required, CASE WHEN mode = 'strong' THEN coalesce(array_to_string(types, ','), '') ELSE '' END AS types FROM m",
    "a3_a4_content_weight": f"WITH {WEIGHTED} SELECT key, owner, ctype AS content_type, owner IS NULL OR owner = user_id AS visible, weight FROM e4",
    "a6_a8_rerank": f"WITH RECURSIVE {RANKED} SELECT request, key, rank, round(rs, 10) AS score, mode, status FROM ranked",
    "a7_evidence_text": f"WITH {EVIDENCE} SELECT key, CASE WHEN coalesce(content, '') <> '' THEN content WHEN predicate IS NOT NULL THEN {SENTENCE} ELSE coalesce(value, '') END AS text FROM ev",
    "a9_flag_for_user": f"WITH RECURSIVE {RANKED}, t AS (SELECT request, key, rs, coalesce(nullif(content, ''), subject || predicate || object, value, '') AS text FROM ranked), h AS (SELECT *, CASE WHEN request % 3 > 0 THEN list_filter({sql_list(ALLERGIES)}, lambda x: contains(text, x)) ELSE [] END AS hits FROM t) SELECT request, key, coalesce(array_to_string(hits, ','), '') AS hits, CASE WHEN len(hits) > 0 THEN substr(text, 1, 120) END AS snippet, round(CASE WHEN len(hits) > 0 THEN rs * 0.3::double ELSE rs END, 10) AS score FROM h",
    "a10_a13_blocks": f"WITH {EVIDENCE} SELECT key, concat_ws(chr(10), '[来源' || key || '] (类型: ' || source_type || ')', CASE WHEN coalesce(content, '') <> '' THEN substr(content, 1, 600) WHEN predicate IS NOT NULL THEN subject || ' --(' || predicate || ')--> ' || object WHEN key % 3 = 2 THEN '鸡蛋: 热量 = ' || value END, CASE WHEN score IS NOT NULL THEN '(相关度: ' || printf('%.3f', round(score + 0.00011::double, 6)) || ')' END) AS block, CASE WHEN key % 2 = 0 THEN key ELSE key * 2 END::varchar AS context_id, CASE WHEN coalesce(content, '') <> '' THEN content WHEN predicate IS NOT NULL THEN trim(concat_ws(' ', subject, predicate, object)) WHEN key % 3 = 2 THEN '鸡蛋 热量 ' || value END AS context FROM ev",
    "a11_cited": f"WITH {EVIDENCE}, c AS (SELECT DISTINCT request, unnest([2, 1, request % {PER}]) AS rank FROM ev) SELECT request, rank::int AS source_id, source_type, coalesce(nullif(substr(content, 1, 200), ''), concat_ws(' ', coalesce(subject, ''), coalesce(predicate, ''), coalesce(object, ''))) AS content FROM (SELECT DISTINCT request, rank FROM c) JOIN (SELECT *, key % {PER} + 1 AS rank FROM ev) USING (request, rank)",
    "a12_missing_answer": f"WITH {REQUESTS_SQL}, t AS (SELECT request_id, n, query, {_policy('query')} AS types FROM requests), m AS (SELECT *, {_mode('query', 'types')} AS mode FROM t) SELECT request_id, CASE WHEN len(types) > 0 THEN replace({sql_text(A.MISSING)}, '{{x}}', array_to_string(list_transform(types, lambda t: CASE t {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in A.CONTENT_NAMES.items())} END), '、')) ELSE {sql_text(A.MISSING_ANY)} END AS answer FROM m WHERE mode = 'strong' AND n % 2 = 1",
    "a14_summaries": f"WITH {EVIDENCE} SELECT request, (key % {PER} + 1)::int AS rank, source_type, key AS chunk_id, coalesce(nullif(substr(content, 1, 160), ''), substr(trim(concat_ws(' ', coalesce(subject, ''), coalesce(predicate, ''), coalesce(object, ''))), 1, 160)) AS preview, array_to_string(range(greatest(key % 30 + 1 - 19, 1), key % 30 + 2), ',') AS recent FROM ev WHERE key % {PER} < 8",
    "e2_e3_planner_scores": f"WITH {EX}, s AS (SELECT *, CASE WHEN len(a) > 0 THEN CASE WHEN len(sb) > 0 THEN h / len(sb) ELSE 0 END END AS p, CASE WHEN len(a) > 0 THEN h / len(sa) END AS r, list_filter(citations, lambda c: c >= 1 AND c <= nc) AS ok FROM xs) SELECT event_id, CASE WHEN expected_intent <> '' THEN (expected_intent = intent)::int::double END AS intent_accuracy, round(p, 6) AS route_precision, round(r, 6) AS route_recall, round(CASE WHEN p IS NOT NULL THEN {F1.format(p='p', r='r')} END, 6) AS route_f1, round(len(ok) / len(citations)::double, 6) AS validity, round(CASE WHEN nc > 0 THEN len(list_distinct(ok)) / nc::double ELSE 0 END, 6) AS coverage FROM s",
    "e6_e8_safety_scores": f"WITH {EX} SELECT event_id, CASE WHEN intent IN ('disease_diet', 'medical') AND NOT {_any('answer', E.SAFETY_TERMS)} THEN 0 ELSE 1 END::double AS safety_notice, (len(list_filter(allergies, lambda x: contains(answer, x))) > 0)::int::double AS allergy_violation, (len(list_filter(restrictions, lambda x: contains(answer, x))) > 0)::int::double AS restriction_violation, (len(list_filter(list_concat(a, allergies), lambda x: contains(answer, x))) > 0)::int::double AS forbidden_violation, (n % 3 = 0 AND contains(answer, '历史问答参考'))::int::double AS context_only_violation, (NOT (n % 3 = 0 AND contains(answer, '历史问答参考')))::int::double AS memory_compliance FROM ex",
    "e9_e11_route_scores": f"WITH {EX}, q AS (SELECT *, list_filter(b, lambda x: list_contains(a, x)) AS q FROM xs), c AS (SELECT *, array_to_string(list_transform(a, lambda x: chr((list_position(sa, x) + 64)::int)), '') AS ca, array_to_string(list_transform(q, lambda x: chr((list_position(sa, x) + 64)::int)), '') AS cq FROM q) SELECT event_id, round(CASE WHEN len(a) = 0 THEN 1 WHEN len(q) = 0 THEN 0 ELSE 1 - levenshtein(ca, cq) / greatest(len(a), len(q))::double END, 6) AS route_order, round(CASE WHEN len(a) = 0 THEN CASE WHEN len(b) > 0 THEN 0 ELSE 1 END WHEN len(b) = 0 THEN 1 ELSE h / len(b) END, 6)::double AS entity_precision, round(CASE WHEN len(a) = 0 THEN 1 ELSE h / len(sa) END, 6)::double AS entity_recall, round(CASE WHEN len(a) = 0 THEN CASE WHEN len(b) > 0 THEN 0 ELSE 1 END WHEN len(b) = 0 THEN 0 ELSE h / len(sb) END, 6)::double AS route_precision, round(CASE WHEN len(a) = 0 THEN 1 ELSE h / len(sa) END, 6)::double AS route_recall, round(CASE WHEN len(a) = 0 THEN CASE WHEN len(b) > 0 THEN 0 ELSE 1 END WHEN len(b) = 0 THEN 0 ELSE h / len(sb) END, 6)::double AS filter_precision, round(CASE WHEN len(a) = 0 THEN 1 ELSE h / len(sa) END, 6)::double AS filter_recall, (len(b) > 0 AND h = 0)::int::double AS filter_false_positive FROM c",
    "e14_e21_examples": f"WITH {EX} SELECT event_id, {_csv('''list_sort(list_filter(list_distinct(list_concat(a, b)), lambda x: x NOT IN ('semantic', 'answer', 'rerank')))''', 'dynamic_routes')}, md5(answer) AS answer_md5 FROM ex",
    "e5_context_use": f"WITH pr AS (SELECT a.conv_id, a.turn, b.turn AS other, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND abs(a.turn - b.turn) <= 2), l AS (SELECT conv_id, turn, other, {LEX.format(c='x')} AS p, {LEX.format(c='y')} AS q FROM pr), k AS (SELECT conv_id, turn, other, any_value(len(p)) AS np, any_value(len(q)) AS nq FROM l GROUP BY ALL), a AS (SELECT conv_id, turn, other, t, count(*) AS n FROM (SELECT conv_id, turn, other, unnest(p) AS t FROM l) GROUP BY ALL), b AS (SELECT conv_id, turn, other, t, count(*) AS n FROM (SELECT conv_id, turn, other, unnest(q) AS t FROM l) GROUP BY ALL), o AS (SELECT a.conv_id, a.turn, a.other, sum(least(a.n, b.n)) AS o FROM a JOIN b USING (conv_id, turn, other, t) GROUP BY ALL) SELECT k.conv_id, k.turn, round(max(coalesce(2 * o / nullif(np + nq, 0)::double, 0)), 6) AS context_utilization FROM k LEFT JOIN o USING (conv_id, turn, other) GROUP BY 1, 2",
    "e15_e20_sessions": f"""WITH {TURNS},
pn AS (SELECT conv_id, count(*) FILTER (WHERE q) AS f, count(*) FILTER (WHERE q AND hit) AS k FROM (SELECT conv_id, regexp_matches(question, '[那这它]') AS q, len(list_intersect(list_filter({LEX.format(c='prev')}, lambda t: length(t) >= 2), list_filter({LEX.format(c='answer')}, lambda t: length(t) >= 2))) > 0 AS hit FROM tp WHERE prev IS NOT NULL) GROUP BY 1),
cl AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, regexp_extract_all(answer, {CLAIM}, 1) AS x, regexp_extract_all(answer, {CLAIM}, 2) AS y, list_transform(regexp_extract_all(answer, {CLAIM}, 3), lambda u: coalesce(u, '')) AS z FROM tn),
cm AS (SELECT conv_id, r, unnest(x) AS attr, unnest(y) AS v, unnest(z) AS u FROM cl),
cc AS (SELECT * FROM cm WHERE attr NOT IN {SKIP}),
ck AS (SELECT p.conv_id, count(DISTINCT (p.r, p.attr)) AS checks FROM cc p JOIN cc c ON p.conv_id = c.conv_id AND c.r = p.r + 1 AND c.attr = p.attr GROUP BY 1),
pi AS (SELECT *, row_number() OVER () AS id FROM cc),
cf AS (SELECT p.conv_id, count(DISTINCT p.id) AS conflicts FROM pi p JOIN cc c ON p.conv_id = c.conv_id AND c.r = p.r + 1 AND c.attr = p.attr AND c.u = p.u AND c.v <> p.v GROUP BY 1),
sq AS (SELECT conv_id, regexp_replace(prev, '[ \\t\\n\\r]+', '', 'g') AS a, regexp_replace(answer, '[ \\t\\n\\r]+', '', 'g') AS b FROM tp WHERE prev IS NOT NULL),
sg AS (SELECT conv_id, {GRAMS10.format(c='a')} AS a, {GRAMS10.format(c='b')} AS b FROM sq),
rp AS (SELECT conv_id, avg(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 1 ELSE 1 - len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double END) AS rep FROM sg GROUP BY 1)
SELECT s.conv_id, round(CASE WHEN coalesce(f, 0) = 0 THEN 1 ELSE k / f::double END, 6) AS pronoun_resolution, round(CASE WHEN coalesce(checks, 0) = 0 THEN 1 ELSE 1 - coalesce(conflicts, 0) / checks::double END, 6) AS factual_consistency, round(coalesce(rep, 1), 6) AS info_repetition FROM (SELECT DISTINCT conv_id FROM tn) s LEFT JOIN pn USING (conv_id) LEFT JOIN ck USING (conv_id) LEFT JOIN cf USING (conv_id) LEFT JOIN rp USING (conv_id)""",
}
QUERIES = {f.__name__: f for f in (a2_policy, a3_a4_content_weight, a6_a8_rerank, a7_evidence_text, a9_flag_for_user, a10_a13_blocks, a11_cited, a12_missing_answer, a14_summaries, e2_e3_planner_scores, e6_e8_safety_scores, e9_e11_route_scores, e14_e21_examples, e5_context_use, e15_e20_sessions)}
