"""Queries of memory over the conversations and events, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory as M
from ..sources.samples import pick, sql_list, sql_text
from ..sources.tables import table
from .agent import _any
from .records import HOT, TIER, WARM

NOW = "2024-12-01 00:00:00"
TAGS = ("general", "recipe_recommend", "disease_diet", "")
ANSWERS = ("抱歉，无法回答", "番茄富含维生素" * 12, "short", "ok " * 40)
VALUES = ("花生", " 虾 ", "", "鱼", "花生")
FIELDS = (*M.FIELDS, "notes", "preferences")
REPLIES = ("是的，保存", "不用", " 好", "", "确认")
TYPES = ("allergy", "temporary_preference", "health_goal", "", "disliked_ingredient")


def _order(c="turn"):
    return F.col("conv_id") * 1000 + F.col(c)


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    t = M.tiers(table(spark, sf, "conversations"), "conv_id", ["turn", "role", "text"], HOT, WARM)
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 86400 + F.col("turn"))
    return t.withColumns({"id": _order(), "archived_at": F.when(F.col("turn") % 2 == 0, when)})


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The summaries of an earlier time: every second session has one, of its first turns."""
    old = M.summarise(_turns(spark, sf), "conv_id", "id", "role", "text", 600).where("conv_id % 2 = 0")
    return old.withColumns({"source_end": F.col("source_start") + F.col("conv_id") % 3, "version": F.lit(1).cast("long")})


def m2_archive(spark: SparkSession, sf: str) -> DataFrame:
    a = M.archive(_turns(spark, sf), F.lit(NOW).cast("timestamp"))
    return a.select("conv_id", "turn", "tier", F.unix_timestamp("archived_at").alias("archived_at"))


def m3_hot_context(spark: SparkSession, sf: str) -> DataFrame:
    return M.hot_context(_turns(spark, sf), "conv_id", ["id"], 2).select("conv_id", "turn", "place")


def m4_summaries(spark: SparkSession, sf: str) -> DataFrame:
    s = M.summarise(_turns(spark, sf), "conv_id", "id", "role", "text", 600)
    return s.select("conv_id", F.md5("summary").alias("summary_md5"), "source_start", "source_end", "n_messages", F.col("n_tokens").cast("long").alias("n_tokens"))


def m6_refresh(spark: SparkSession, sf: str) -> DataFrame:
    r = M.refresh(_turns(spark, sf), _summaries(spark, sf), "conv_id", "id", "role", "text", 2, 600)
    return r.select("conv_id", "source_start", "source_end", "pending", "version")


def m7_pending(spark: SparkSession, sf: str) -> DataFrame:
    return M.pending(_turns(spark, sf), _summaries(spark, sf), "conv_id", "id").select("conv_id", "turn")


def m8_full_context(spark: SparkSession, sf: str) -> DataFrame:
    c = M.full_context(_turns(spark, sf), _summaries(spark, sf), "conv_id", "id", "role", "text", 2, 600)
    return c.select("conv_id", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("n_chars"))


def m9_m21_add_turns(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf).drop("id")
    new = table(spark, sf, "conversations").where("turn = 0").withColumns({"turn": F.lit(900).cast("long"), "text": F.lit("again")})
    a = M.add_turns(t, new, "conv_id", ["turn", "role", "text"], F.lit(NOW).cast("timestamp"), HOT, WARM, 6, 330)
    return M.without_session(a, "conv_id", 3).select("conv_id", "turn", "role", "tier", F.unix_timestamp("archived_at").alias("archived_at"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf, "events").select(n, pick(ANSWERS, n).alias("answer"), F.transform(F.when(n % 5 > 0, F.sequence(F.lit(1).cast("long"), n % 5)).otherwise(F.array().cast("array<bigint>")), lambda i: i.cast("string")).alias("citations"), F.when(n % 6 > 0, F.array(pick(TAGS, F.floor(n / 3)))).otherwise(F.array().cast("array<string>")).alias("tags"), (n % 7).alias("evidence"))


def m10_quality(spark: SparkSession, sf: str) -> DataFrame:
    a = _answers(spark, sf).withColumn("q", M.quality(F.col("answer"), F.col("citations"), F.col("tags"), F.col("evidence")))
    return a.select("event_id", F.round("q.score", 6).alias("score"), F.array_join("q.reasons", ",").alias("reasons"))


def m12_reuse(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    score = F.round(0.75 + (n % 26) / 100, 2)
    return _answers(spark, sf).select(n, M.reuse_policy(score, F.col("tags")).alias("policy"), F.coalesce(M.reusable(score, F.col("tags"), F.when(n % 2 == 0, "general")), F.lit(False)).alias("reusable"))


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = F.col("event_id")
    e = table(spark, sf, "events").select(n, F.concat(F.lit("q"), n.cast("string")).alias("question"), F.concat(F.lit("a"), n.cast("string")).alias("answer"), F.array(F.col("event_type"), F.lit("")).alias("entities"), F.array(F.lit("general")).alias("tags"), F.transform(F.sequence(F.lit(1).cast("long"), n % 23 + 1), lambda i: (i + n % 3).cast("string")).alias("citations"), F.round((n % 10) / 10.0, 1).alias("quality"))
    entries = e.where("event_id % 3 = 0").withColumn("hits", n % 4).withColumnRenamed("event_id", "id")
    new = e.where("event_id % 3 = 1").withColumnRenamed("event_id", "new_id")
    matches = new.select("new_id", (F.floor(F.col("new_id") / 9) * 9).alias("id"), F.round(0.88 + (F.col("new_id") % 10) / 100, 2).alias("similarity"))
    return entries, new, matches


def m11_store_answers(spark: SparkSession, sf: str) -> DataFrame:
    s = M.store_answers(*_stored(spark, sf))
    return s.select("id", "question", "answer", F.array_join("entities", ",").alias("entities"), F.array_join("citations", ",").alias("citations"), "quality", "hits")


def m13_m19_hits(spark: SparkSession, sf: str) -> DataFrame:
    entries, _, matches = _stored(spark, sf)
    found = matches.where("similarity >= 0.9")
    rated = M.rate(M.count_hits(entries.withColumn("rating", F.lit(0.0)), found), matches.select("id", F.col("similarity").alias("rating"), F.col("new_id").alias("seq")))
    whole = M.entries_found(rated, found.select("id", "similarity").distinct())
    return whole.groupBy("id", "hits", "rating").agg(F.max("similarity").alias("similarity"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    op = F.when((n % 11 == 0) & (n % 7 < 5), "set").otherwise("append")
    value = F.when(op == "set", F.concat_ws(",", pick(VALUES, n), pick(VALUES, F.floor(n / 2)))).otherwise(pick(VALUES, F.floor(n / 3)))
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), n.alias("seq"), pick(FIELDS, n).alias("field"), F.when(n % 7 == 6, F.col("event_type")).alias("key"), value.alias("value"), op.alias("op"))


def m14_m20_profiles(spark: SparkSession, sf: str) -> DataFrame:
    p = M.profiles(_log(spark, sf))
    return p.select("user_id", *(F.array_join(f, ",").alias(f) for f in M.FIELDS), "notes", F.array_join(F.transform(F.map_entries("preferences"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("preferences"))


def m15_profile_text(spark: SparkSession, sf: str) -> DataFrame:
    p = M.profiles(_log(spark, sf)).withColumn("c", M.ingredient_check(F.col("allergies"), F.lit("花生")))
    return p.select("user_id", M.profile_text().alias("text"), "c.safe", "c.reason", "c.type")


def m17_memory_prompt(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    score = F.round(0.75 + (n % 26) / 100, 2)
    prompt = M.memory_prompt(F.when(n % 2 == 0, "h").otherwise(""), F.when(n % 3 == 0, M.NO_PROFILE).otherwise("p"), F.when(n % 5 > 0, "q"), F.col("answer"), score, M.reuse_policy(score, F.col("tags")), pick(TAGS, n))
    return _answers(spark, sf).select(n, prompt.alias("prompt"))


def f13_confirmation(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    one = F.struct(pick(TYPES, n).alias("type"), pick(VALUES, n).alias("value"), F.when(n % 2 == 0, "e").alias("evidence"))
    two = F.struct(pick(TYPES, F.floor(n / 5)).alias("type"), F.col("event_type").alias("value"), F.lit("").alias("evidence"))
    p = table(spark, sf, "events").select(n, F.col("user_id").cast("string").alias("user_id"), M.confirmation(F.array(one, two)).alias("c"), pick(REPLIES, F.floor(n / 2)).alias("reply")).where("c is not null").select(n, "user_id", "c.*", "reply")
    asked = p.select(F.lit("asked").alias("what"), F.col("event_id").alias("seq"), F.col("question").alias("value"))
    writes = M.confirmed_writes(p, "user_id", "event_id", "candidates", "reply")
    return asked.unionByName(writes.select(F.col("field").alias("what"), "seq", "value"))


LINE = "CASE WHEN role = 'user' THEN '用户: ' ELSE '助手: ' END || {t}"
FLAT = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
TOK = "greatest(floor(length({c}) * 0.7::double)::int, 1)"


def _trim_sql(col: str, budget: int) -> str:
    """The last lines of a text within budget: lines with their sums from the end, and whether an earlier one broke it."""
    lines = f"list_reverse(string_split({col}, chr(10)))"
    tok = TOK.format(c="x")
    first_over = f"list_position(list_transform(range(1, len(l) + 1), lambda i: i > 1 AND list_sum(t[1:i]) > {budget}), true)"
    return f"(SELECT CASE WHEN {TOK.format(c='w')} <= {budget} THEN w ELSE array_to_string(list_reverse(l[1:coalesce({first_over}, len(l) + 1) - 1]), chr(10)) END FROM (SELECT w, l, list_transform(l, lambda x: {tok}) AS t FROM (SELECT {col} AS w, {lines} AS l)))"


TURNS = f"{TIER}, tn AS (SELECT *, conv_id * 1000 + turn AS id, CASE WHEN turn % 2 = 0 THEN 1704067200 + conv_id * 86400 + turn END AS archived_at FROM tiers)"
SUMMARY = f"""{TURNS}, sw AS (SELECT conv_id, string_agg({LINE.format(t=f'substr({FLAT}, 1, 240)')}, chr(10) ORDER BY id) AS whole, min(id) AS source_start, max(id) AS source_end, count(*) AS n_messages FROM tn WHERE tier = 'warm' GROUP BY 1),
sm AS (SELECT conv_id, {_trim_sql('whole', 400)} AS summary, source_start, source_end, n_messages FROM sw),
old AS (SELECT conv_id, summary, source_start, source_start + conv_id % 3 AS source_end, n_messages, 1 AS version FROM sm WHERE conv_id % 2 = 0)"""
QUALITY = f"""qa AS (SELECT event_id, {sql_list(ANSWERS)}[event_id % 4 + 1] AS answer, event_id % 5 AS nc, CASE WHEN event_id % 6 > 0 THEN {sql_list(TAGS)}[event_id // 3 % 4 + 1] END AS tag, event_id % 7 AS ev FROM events)"""
SAFE = "coalesce({t} IN ('nutrition_info', 'ingredient_knowledge', 'recipe_recommend', 'general'), false)"
STORED = """ee AS (SELECT event_id, 'q' || event_id AS question, 'a' || event_id AS answer, event_type, list_transform(range(1, event_id % 23 + 2), lambda i: (i + event_id % 3)::varchar) AS citations, round(event_id % 10 / 10.0::double, 1) AS quality FROM events),
en AS (SELECT *, event_id AS id, event_id % 4 AS hits FROM ee WHERE event_id % 3 = 0),
mt AS (SELECT event_id AS new_id, event_id // 9 * 9 AS id, round(0.88::double + event_id % 10 / 100.0::double, 2) AS similarity FROM ee WHERE event_id % 3 = 1)"""
LOG = f"""lg AS (SELECT user_id::varchar AS user_id, event_id AS seq, {sql_list(FIELDS)}[event_id % 7 + 1] AS field, CASE WHEN event_id % 7 = 6 THEN event_type END AS key, event_id % 11 = 0 AND event_id % 7 < 5 AS sets, event_id FROM events),
lv AS (SELECT *, CASE WHEN sets THEN [trim({sql_list(VALUES)}[event_id % 5 + 1]), trim({sql_list(VALUES)}[event_id // 2 % 5 + 1])] ELSE [trim({sql_list(VALUES)}[event_id // 3 % 5 + 1])] END AS vs, {sql_list(VALUES)}[event_id // 3 % 5 + 1] AS raw FROM lg),
lf AS (SELECT user_id, field, seq, unnest(vs) AS x, unnest(range(len(vs))) AS i FROM lv WHERE field NOT IN ('notes', 'preferences')),
ls AS (SELECT user_id, field, max(seq) AS f FROM lv WHERE sets GROUP BY ALL),
lk AS (SELECT user_id, field, x, min((seq, i)) AS ord FROM lf LEFT JOIN ls USING (user_id, field) WHERE (f IS NULL OR seq >= f) AND x <> '' GROUP BY ALL),
lj AS (SELECT user_id, field, string_agg(x, ',' ORDER BY ord) AS v, string_agg(x, '、' ORDER BY ord) AS d, list(x) AS xs FROM lk GROUP BY ALL),
no AS (SELECT user_id, max_by(raw, seq) AS notes FROM lv WHERE field = 'notes' GROUP BY 1),
pf AS (SELECT user_id, string_agg(key || '=' || v, ',' ORDER BY key) AS prefs FROM (SELECT user_id, key, max_by(raw, seq) AS v FROM lv WHERE field = 'preferences' GROUP BY ALL) GROUP BY 1),
us AS (SELECT DISTINCT user_id FROM lg)"""
PIECES = ", ".join(f"(SELECT '{n}：' || d FROM lj WHERE lj.user_id = us.user_id AND field = '{f}')" for f, n in M.FIELDS.items())
KIND_NAMES = "CASE t " + " ".join(f"WHEN '{k}' THEN '{M.FIELDS[f]}'" for k, f in M.KINDS.items()) + " ELSE t END"
KIND_FIELDS = "CASE t " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in M.KINDS.items()) + " END"
SHORT = f"CASE WHEN length({{c}}) <= 180 THEN {{c}} ELSE rtrim(substr({{c}}, 1, 180)) || '...' END"

SQL = {
    "m2_archive": f"WITH {TURNS} SELECT conv_id, turn, tier, CASE WHEN tier = 'cold' THEN coalesce(archived_at, epoch(timestamp '{NOW}')::bigint) END AS archived_at FROM tn",
    "m3_hot_context": f"WITH {TURNS} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY id) AS place FROM (SELECT * FROM tn WHERE tier = 'hot' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) <= 2)",
    "m4_summaries": f"WITH {SUMMARY} SELECT conv_id, md5(summary) AS summary_md5, source_start, source_end, n_messages, {TOK.format(c='summary')} AS n_tokens FROM sm",
    "m6_refresh": f"WITH {SUMMARY}, ch AS (SELECT tn.conv_id, count(*) FILTER (WHERE NOT coalesce(id BETWEEN source_start AND source_end, false)) AS n FROM tn LEFT JOIN old USING (conv_id) WHERE tier = 'warm' GROUP BY 1) SELECT sm.conv_id, CASE WHEN version IS NULL OR n >= 2 THEN sm.source_start ELSE old.source_start END AS source_start, CASE WHEN version IS NULL OR n >= 2 THEN sm.source_end ELSE old.source_end END AS source_end, CASE WHEN version IS NULL OR n >= 2 THEN 0 ELSE n END AS pending, CASE WHEN version IS NULL THEN 1 WHEN n >= 2 THEN 2 ELSE 1 END AS version FROM sm JOIN ch USING (conv_id) LEFT JOIN old USING (conv_id)",
    "m7_pending": f"WITH {SUMMARY} SELECT conv_id, turn FROM tn JOIN old USING (conv_id) WHERE tier = 'warm' AND id > source_end",
    "m8_full_context": f"""WITH {SUMMARY}, h AS (SELECT conv_id, string_agg({LINE.format(t="coalesce(text, '')")}, chr(10) ORDER BY id) AS h FROM tn WHERE tier = 'hot' GROUP BY 1), l AS (SELECT conv_id, string_agg({LINE.format(t="coalesce(text, '')")}, chr(10) ORDER BY id) AS l FROM tn JOIN old USING (conv_id) WHERE tier = 'warm' AND id > source_end GROUP BY 1),
w AS (SELECT h.conv_id, concat_ws(chr(10) || chr(10), '温层历史摘要:' || chr(10) || nullif(summary, ''), '尚未归入温层摘要的较早对话:' || chr(10) || l, '最近对话:' || chr(10) || h) AS whole FROM h LEFT JOIN old USING (conv_id) LEFT JOIN l USING (conv_id)), t AS (SELECT conv_id, {_trim_sql('whole', 600)} AS c FROM w) SELECT conv_id, md5(c) AS context_md5, length(c) AS n_chars FROM t""",
    "m9_m21_add_turns": f"""WITH al AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN 1704067200 + conv_id * 86400 + turn END AS archived_at FROM conversations UNION ALL SELECT conv_id, 900, role, 'again', NULL FROM conversations WHERE turn = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM al), t AS (SELECT conv_id, turn, role, text, CASE WHEN r <= {HOT} THEN 'hot' WHEN r <= {HOT + WARM} THEN 'warm' ELSE 'cold' END AS tier, archived_at FROM r), a AS (SELECT * REPLACE (CASE WHEN tier = 'cold' THEN coalesce(archived_at, epoch(timestamp '{NOW}')::bigint) END AS archived_at) FROM t),
x AS (SELECT * FROM a WHERE NOT coalesce(tier = 'cold' AND archived_at < epoch(timestamp '{NOW}')::bigint - 330 * 86400, false)), n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, tier ORDER BY turn, role, text) AS k FROM x)
SELECT conv_id, turn, role, tier, archived_at FROM n WHERE (tier <> 'cold' OR k > n - 6) AND conv_id IS DISTINCT FROM 3""",
    "m10_quality": f"WITH {QUALITY}, s AS (SELECT *, length(trim(answer)) >= 80 AS long, coalesce(tag, '') NOT IN ('', 'general') AS sp, {_any('answer', M.FAILED)} AS bad, coalesce(tag IN ('disease_diet', 'diet_advice'), false) AS un FROM qa) SELECT event_id, round(greatest(0, least(1, CASE WHEN nc > 0 THEN least(0.35::double, 0.2::double + 0.05::double * nc) ELSE 0 END + CASE WHEN long THEN 0.25::double ELSE -0.2::double END + CASE WHEN ev > 0 THEN least(0.15::double, ev * 0.03::double) ELSE 0 END + CASE WHEN sp THEN 0.1::double ELSE 0 END - CASE WHEN bad THEN 0.4::double ELSE 0 END - CASE WHEN un THEN 0.05::double ELSE 0 END)), 6) AS score, concat_ws(',', CASE WHEN nc > 0 THEN 'has_citations' ELSE 'no_citations' END, CASE WHEN long THEN 'sufficient_length' ELSE 'too_short' END, CASE WHEN ev > 0 THEN 'has_evidence' END, CASE WHEN sp THEN 'specific_intent' END, CASE WHEN bad THEN 'low_quality_phrase' END, CASE WHEN un THEN 'sensitive_intent' END) AS reasons FROM s",
    "m12_reuse": f"WITH {QUALITY}, s AS (SELECT *, round(0.75::double + event_id % 26 / 100.0::double, 2) AS k FROM qa) SELECT event_id, CASE WHEN k >= 0.94 AND {SAFE.format(t='tag')} THEN 'direct_reuse' WHEN k >= 0.82 THEN 'context_only' ELSE 'ignore' END AS policy, k >= 0.94 AND {SAFE.format(t='''CASE WHEN event_id % 2 = 0 THEN 'general' ELSE tag END''')} AS reusable FROM s",
    "m11_store_answers": f"WITH {STORED}, gd AS (SELECT ee.*, event_id AS new_id FROM ee WHERE event_id % 3 = 1 AND quality >= 0.65), ht AS (SELECT gd.*, mt.id AS to_id FROM gd JOIN mt USING (new_id) WHERE similarity >= 0.92), gr AS (SELECT to_id AS id, arg_max(new_id, (quality, -new_id)) AS b, max(quality) AS bq, count(*) AS k FROM ht GROUP BY 1), ci AS (SELECT id, 0 AS s, 0 AS n, citations AS c, [event_type, ''] AS e FROM en UNION ALL SELECT to_id, 1, new_id, citations, [event_type, ''] FROM ht), cx AS (SELECT id, x, min((s, n, i)) AS ord FROM (SELECT id, s, n, unnest(c) AS x, unnest(range(len(c))) AS i FROM ci) GROUP BY ALL), cy AS (SELECT id, list(x ORDER BY ord) AS c FROM cx GROUP BY 1), ex AS (SELECT id, x, min((s, n)) AS ord FROM (SELECT id, s, n, unnest(e) AS x FROM ci) WHERE x <> '' GROUP BY ALL), ey AS (SELECT id, string_agg(x, ',' ORDER BY ord) AS e FROM ex GROUP BY 1) SELECT en.id, CASE WHEN coalesce(bq >= quality, false) THEN 'q' || b ELSE question END AS question, CASE WHEN coalesce(bq >= quality, false) THEN 'a' || b ELSE answer END AS answer, CASE WHEN k > 0 THEN ey.e ELSE event_type || ',' END AS entities, array_to_string(CASE WHEN k > 0 THEN cy.c[1:20] ELSE citations END, ',') AS citations, CASE WHEN coalesce(bq >= quality, false) THEN bq ELSE quality END AS quality, hits + coalesce(k, 0) AS hits FROM en LEFT JOIN gr USING (id) LEFT JOIN cy USING (id) LEFT JOIN ey USING (id) UNION ALL SELECT (SELECT max(id) FROM en) + row_number() OVER (ORDER BY new_id), question, answer, event_type || ',', array_to_string(citations, ','), quality, 0 FROM gd WHERE new_id NOT IN (SELECT new_id FROM ht)",
    "m13_m19_hits": f"WITH {STORED}, h AS (SELECT id, count(*) FILTER (WHERE similarity >= 0.9) AS k, max(similarity) FILTER (WHERE similarity >= 0.9) AS m, max_by(similarity, new_id) AS rt FROM mt GROUP BY 1) SELECT id, hits + k AS hits, rt AS rating, m AS similarity FROM en JOIN h USING (id) WHERE k > 0",
    "m14_m20_profiles": f"WITH {LOG} SELECT us.user_id, {', '.join(f'''coalesce((SELECT v FROM lj WHERE lj.user_id = us.user_id AND field = '{f}'), '') AS {f}''' for f in M.FIELDS)}, coalesce(notes, '') AS notes, coalesce(prefs, '') AS preferences FROM us LEFT JOIN no USING (user_id) LEFT JOIN pf USING (user_id)",
    "m15_profile_text": f"WITH {LOG}, a AS (SELECT us.user_id, notes, concat_ws('；', {PIECES}, CASE WHEN notes <> '' THEN '备注：' || notes END) AS t, coalesce((SELECT list_contains(xs, '花生') FROM lj WHERE lj.user_id = us.user_id AND field = 'allergies'), false) AS bad FROM us LEFT JOIN no USING (user_id)) SELECT user_id, coalesce(nullif(t, ''), '{M.NO_PROFILE}') AS text, NOT bad AS safe, CASE WHEN bad THEN '过敏源: 花生' ELSE '' END AS reason, CASE WHEN bad THEN 'allergy' END AS type FROM a",
    "m17_memory_prompt": f"WITH {QUALITY}, s AS (SELECT *, round(0.75::double + event_id % 26 / 100.0::double, 2) AS k, {sql_list(TAGS)}[event_id % 4 + 1] AS intent, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS flat FROM qa), d AS (SELECT *, k >= 0.94 AND {SAFE.format(t='tag')} AND (intent = '' OR {SAFE.format(t='intent')}) AS direct FROM s) SELECT event_id, concat_ws({sql_text(chr(10) + chr(10))}, CASE WHEN event_id % 2 = 0 THEN {sql_text('## 最近对话历史' + chr(10) + 'h')} END, CASE WHEN event_id % 3 > 0 THEN {sql_text('## 用户画像' + chr(10) + 'p')} END, CASE WHEN event_id % 5 > 0 THEN CASE WHEN direct THEN {sql_text('## 可强参考的历史问答' + chr(10))} ELSE {sql_text('## 仅供理解意图的历史问答' + chr(10))} END || {sql_text('Q: q' + chr(10))} || CASE WHEN direct THEN 'A: ' || answer ELSE '摘要: ' || {SHORT.format(c='flat')} END || {sql_text(chr(10) + '相似度: ')} || printf('%.3f', k) END) AS prompt FROM d",
    "f13_confirmation": f"""WITH c AS (SELECT event_id, {sql_list(REPLIES)}[event_id // 2 % 5 + 1] AS reply, unnest([1, 2]) AS i, unnest([{sql_list(TYPES)}[event_id % 5 + 1], {sql_list(TYPES)}[event_id // 5 % 5 + 1]]) AS t, unnest([{sql_list(VALUES)}[event_id % 5 + 1], event_type]) AS v, unnest([CASE WHEN event_id % 2 = 0 THEN 'e' END, '']) AS e FROM events), k AS (SELECT * FROM c WHERE t <> '' AND v <> '' AND t <> 'temporary_preference')
SELECT 'asked' AS what, event_id AS seq, {sql_text('我注意到以下可能和您个人相关的信息：' + chr(10))} || string_agg('- ' || {KIND_NAMES} || '：' || v || CASE WHEN coalesce(e, '') <> '' THEN '（根据：' || e || '）' ELSE '' END, chr(10) ORDER BY i) || {sql_text(chr(10) + chr(10) + '是否将这些信息保存到您的个人档案？(是/否)')} AS value FROM k GROUP BY event_id UNION ALL SELECT {KIND_FIELDS}, event_id, v FROM k WHERE {KIND_FIELDS} IS NOT NULL AND ({' OR '.join(f"starts_with(trim(reply), '{w}')" for w in M.YES)})""",
}
QUERIES = {f.__name__: f for f in (m2_archive, m3_hot_context, m4_summaries, m6_refresh, m7_pending, m8_full_context, m9_m21_add_turns, m10_quality, m12_reuse, m11_store_answers, m13_m19_hits, m14_m20_profiles, m15_profile_text, m17_memory_prompt, f13_confirmation)}
