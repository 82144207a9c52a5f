"""Queries of blocks, tables, classes, chunks and facts over the notes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import chunks as H
from ..operators import classes as C
from ..operators import facts as G
from ..operators import planning as P
from ..operators.text import VALID
from ..sources.samples import NOTES_SQL, notes, requests, sql_list, sql_text
from ..sources.tables import table
from .agent import SIGNALS, _any, _times
from .retrieval import lines_sql

TODAY = "2024-06-01"
ATTRS = ("禁忌人群", "搭配", "主要食材", "热量", "category", "烹饪难度", "备注")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("doc_id", "text", B.block_list(F.col("text")).alias("blocks"))


def _md5(c):
    return F.md5(c)


def p2_p9_tables(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf).select("doc_id", F.posexplode("blocks").alias("i", "b")).where("b.kind = 'table'")
    t = b.select("doc_id", (F.col("i") + 1).cast("long").alias("block"), B.table_cells(F.col("b.content")).alias("t")).withColumn("c", B.clean_table(F.col("t")))
    return t.select("doc_id", "block", F.array_join("t.headers", "|").alias("headers"), F.size("t.rows").cast("long").alias("n_rows"), B.table_text(F.col("t")).alias("text"), B.table_text(F.col("c"), rule=False).alias("clean"))


def p3_p4_document_text(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("doc_id", B.title(F.col("blocks")).alias("title"), _md5(B.document_text(F.col("blocks"))).alias("body_md5"))


def p10_images(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    description, ocr = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), F.col("source"))), F.when(F.col("doc_id") % 4 == 0, F.col("text"))
    i = d.select("doc_id", B.clean_image(description, ocr, F.when(F.col("doc_id") % 5 == 0, F.lit("x").cast("binary"))).alias("i")).where("i is not null")
    return i.select("doc_id", "i.description", _md5(F.col("i.ocr_text")).alias("ocr_md5"))


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return C.classified(notes(spark, sf), "text")


def c1_c6_c15_classify(spark: SparkSession, sf: str) -> DataFrame:
    c = _classified(spark, sf)
    scores = F.transform("scores", lambda s: F.concat_ws(":", s["category"], s["score"].cast("string")))
    return c.select("doc_id", "category", "confidence", F.array_join("secondary", ",").alias("secondary"), "method", F.array_join(scores, ",").alias("scores"), "needs_model")


def _chunks(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    docs = _blocks(spark, sf).withColumn("body", B.document_text(F.col("blocks")))
    return H.chunked(docs, "doc_id", "blocks", "body", kind, TODAY).select("doc_id", "chunk_type", _md5(F.col("content")).alias("content_md5"), "label")


def h6_recipe_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, "recipe")


def h7_nutrition_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, "nutrition")


def h8_medical_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, "medical")


def h9_daily_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = _blocks(spark, sf).withColumn("body", B.document_text(F.col("blocks")))
    d = H.chunked(docs, "doc_id", "blocks", "body", "daily", TODAY)
    return d.select("doc_id", F.col("label").alias("date"), _md5(F.col("content")).alias("content_md5"), F.array_join(H.meals(F.col("content")), ",").alias("meals"))


def h10_personal_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, "personal")


def h1_h3_chunk_by_category(spark: SparkSession, sf: str) -> DataFrame:
    made = H.for_display(H.chunked(_classified(spark, sf), "doc_id", "blocks", "body", F.col("category"), TODAY))
    return made.select("doc_id", "chunk_type", _md5(F.col("content")).alias("content_md5"), "label", "display_format")


def h4_similarity_parts(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf).select("doc_id", F.posexplode("blocks").alias("block", "b")).where("b.kind <> 'table'").select("doc_id", "block", F.col("b.content").alias("content"))
    return H.split_long(b, "content", above=None).select("doc_id", "block", "part", _md5(F.col("content")).alias("content_md5"), H.grade(H.token_count(F.col("content"))).alias("grade"))


def h5_clause_parts(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf).select("doc_id", F.posexplode("blocks").alias("block", "b")).where("b.kind <> 'table'").select("doc_id", "block", F.col("b.content").alias("content"))
    return H.split_long(b, "content", H.clause_parts, above=None).select("doc_id", "block", "part", _md5(F.col("content")).alias("content_md5"))


def h11_split_long(spark: SparkSession, sf: str) -> DataFrame:
    return H.split_long(notes(spark, sf), "text").select("doc_id", "part", _md5(F.col("text")).alias("content_md5"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return G.extract_facts(notes(spark, sf), "doc_id", "text")


def g2_rule_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf)


def g3_merge_facts(spark: SparkSession, sf: str) -> DataFrame:
    return G.merge_facts(_facts(spark, sf), "doc_id")


def g4_measures(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf)
    return G.measures(n, "doc_id", "text").unionByName(G.ingredients(n, "doc_id", "text").withColumn("unit", F.lit("line"))).groupBy("doc_id", "name", "amount", "unit").agg(F.count("*").alias("n"))


def _attributes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    value = F.when(n % 9 == 0, "").when(n % 4 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", F.concat(F.lit("Brand#"), ((n % 50) + 10).cast("string"))))
    attr = F.element_at(P.strings(*ATTRS), (n % len(ATTRS) + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_brand").alias("entity"), attr.alias("attr"), value.alias("value"), (F.col("p_size") / 50.0).alias("confidence"), n.alias("seq"))


def g5_first_values(spark: SparkSession, sf: str) -> DataFrame:
    return G.first_values(_attributes(spark, sf))


def g6_g8_fact_triples(spark: SparkSession, sf: str) -> DataFrame:
    a = _attributes(spark, sf)
    return G.triples_of_facts(a, a).select("subject", "predicate", "object", "object_type", F.round("confidence", 6).alias("confidence"), "seq")


def g7_attribute_shapes(spark: SparkSession, sf: str) -> DataFrame:
    n, name = F.col("p_partkey"), F.col("p_name")
    a = F.to_json(F.struct(F.array(F.struct(F.lit("name").alias("attr"), name.alias("value"), F.lit(0.5).alias("confidence")), F.struct(F.lit("brand").alias("attr"), F.col("p_brand").alias("value"), F.lit(None).cast("double").alias("confidence"))).alias("attributes")))
    b = F.to_json(F.struct(F.lit(0.6).alias("confidence"), F.struct(F.array("p_brand", "p_type").alias("tags"), F.lit("").alias("empty"), F.col("p_size").alias("size")).alias("attributes"), F.lit("food").alias("type")))
    c = F.to_json(F.struct(F.col("p_size").cast("string").alias("amount"), F.lit("g").alias("unit"), F.lit("").alias("role")))
    value = F.when(n % 3 == 0, a).when(n % 3 == 1, b).otherwise(c)
    return table(spark, sf, "part").select(n, F.inline(G.attributes_of(value)))


def g9_g10_text_triples(spark: SparkSession, sf: str) -> DataFrame:
    return G.first_of(G.text_triples(notes(spark, sf), "doc_id", "text"), "doc_id")


def g11_user_content(spark: SparkSession, sf: str) -> DataFrame:
    r = requests(spark, sf).withColumn("c", P.content_class(F.col("query"))).where("c.content_type is not null").select("request_id", "user_id", "query", F.col("c.content_type").alias("kind"), F.lit("s1").alias("session"))
    s = G.stamp_user_content(r, "user_id", "session", "kind", "query")
    return s.select("request_id", "source_doc_id", "doc_category", F.col("metadata")["user_content_type"].alias("content_type"))


def rx(pattern: str) -> str:
    return sql_text(pattern.replace("(?md)", "(?m)").replace("(?d)", ""))


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
CELLS = "list_transform(string_split(regexp_replace(regexp_replace({}, '^\\|+', ''), '\\|+$', ''), '|'), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g'))"
SEP = "'\\|[\\s\\-:|]+\\|'"
NL, NL2 = "chr(10)", "chr(10) || chr(10)"
BLOCKS = f"""{NOTES_SQL}, {lines_sql('notes')},
tabs AS (SELECT doc_id, block, CASE WHEN regexp_full_match(l[1], {SEP}) THEN []::varchar[] ELSE {CELLS.format('l[1]')} END AS headers, list_transform(list_filter(l[2:], lambda x: NOT regexp_full_match(x, {SEP})), lambda x: {CELLS.format('x')}) AS rows FROM (SELECT doc_id, block, string_split(content, chr(10)) AS l FROM blocks WHERE kind = 'table')),
tt AS (SELECT *, array_to_string(headers, ' | ') AS head, coalesce(array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), chr(10)), '') AS tail FROM tabs),
bt AS (SELECT b.doc_id, b.block, b.kind, b.content, t.headers, t.rows, CASE WHEN b.kind <> 'table' THEN b.content WHEN len(headers) = 0 THEN tail WHEN len(rows) = 0 THEN head || chr(10) || repeat('-', length(head)) ELSE head || chr(10) || repeat('-', length(head)) || chr(10) || tail END AS txt, CASE WHEN b.kind <> 'table' THEN b.content WHEN len(headers) = 0 THEN tail WHEN len(rows) = 0 THEN head ELSE head || chr(10) || tail END AS flat FROM blocks b LEFT JOIN tt t USING (doc_id, block)),
bodies AS (SELECT n.doc_id, coalesce(string_agg(txt, {NL2} ORDER BY block) FILTER (WHERE kind <> 'list'), '') AS body, coalesce(min_by(regexp_replace(regexp_extract(content, '^#{{1,2}}\\s+([^\\n]+)', 1), '^\\s+|\\s+$', '', 'g'), block) FILTER (WHERE kind = 'text' AND regexp_matches(content, '^#{{1,2}}\\s+[^\\n]+')), '') AS title FROM notes n LEFT JOIN bt USING (doc_id) GROUP BY 1)"""


def _category(c: str) -> str:
    sign = sql_list(C.HEADERS[c])
    kw = " + ".join(_times("lower(whole)", t.lower()) for t in C.TERMS[c])
    shape = {"nutrition": "CASE WHEN tables > 0.5 THEN 2 ELSE 0 END", "daily": "CASE WHEN tables > 0.5 THEN 1 ELSE 0 END", "recipe": "CASE WHEN lists > 0.3 THEN 2 ELSE 0 END + CASE WHEN steps >= 3 THEN 5 ELSE 0 END"}.get(c, "0")
    heads = f"coalesce((SELECT sum(3 * CASE WHEN list_has_any(list_transform(u, lambda h: lower(h)), {sign}) THEN len(u) ELSE len(list_filter(u, lambda h: list_contains({sign}, h))) END) FROM (SELECT list_distinct(headers) AS u FROM tabs WHERE tabs.doc_id = w.doc_id)), 0)"
    late = 20 + (("nutrition", "daily", "recipe").index(c) if c in ("nutrition", "daily", "recipe") else 9)
    return f"SELECT doc_id, '{c}' AS cat, coalesce(strong = '{c}', false) AS st, {kw} AS kw, {heads} AS hd, {shape} AS sh, {C.CATEGORIES.index(c)} AS k, {10 + list(C.HEADERS).index(c)} AS hk, {late} AS sk FROM w"


CLASSES = f"""{BLOCKS},
shape AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'table') / count(*)::double AS tables, count(*) FILTER (WHERE kind = 'list') / count(*)::double AS lists FROM blocks GROUP BY 1),
w AS (SELECT b.doc_id, body, concat_ws(chr(10), b.title, body) AS whole, coalesce(tables, 0) AS tables, coalesce(lists, 0) AS lists, len(regexp_extract_all(body, {rx(C.STEP)})) AS steps,
 CASE {" ".join(f"WHEN regexp_matches(concat_ws(chr(10), b.title, body), {rx(p)}) THEN '{k}'" for k, p in C.STRONG.items())} END AS strong FROM bodies b LEFT JOIN shape USING (doc_id)),
parts AS ({" UNION ALL ".join(map(_category, C.CATEGORIES))}),
scored AS (SELECT doc_id, cat, st::int * 10 + kw + hd + sh AS score, CASE WHEN st THEN -1 WHEN kw > 0 THEN k WHEN hd > 0 THEN hk ELSE sk END AS ord FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS r, sum(score) OVER (PARTITION BY doc_id) AS total FROM scored WHERE score > 0),
tops AS (SELECT doc_id, max(cat) FILTER (WHERE r = 1) AS best, max(score) FILTER (WHERE r = 1) AS s1, coalesce(max(score) FILTER (WHERE r = 2), 0) AS s2, any_value(total) AS total, string_agg(cat, ',' ORDER BY r) FILTER (WHERE r IN (2, 3) AND score / total::double >= 0.2) AS secondary, string_agg(cat || ':' || score::bigint, ',' ORDER BY r) AS scores FROM ranked GROUP BY 1),
classes AS (SELECT w.doc_id, body, strong, CASE WHEN coalesce(s1 / total::double, 0) < 0.3 THEN 'unknown' ELSE best END AS category, coalesce(round(s1 / total::double, 4), 0) AS confidence, coalesce(secondary, '') AS secondary, coalesce(scores, '') AS scores, coalesce(s1 - s2, 0) AS margin FROM w LEFT JOIN tops USING (doc_id))"""
RECIPE = f"""rname AS (SELECT doc_id, coalesce(min_by(x, (block, i)), '') AS short FROM (SELECT doc_id, block, i, {STRIP.format('l[i]')} AS x FROM (SELECT doc_id, block, l, unnest(range(1, least(len(l), 3) + 1)) AS i FROM (SELECT doc_id, block, string_split(content, chr(10)) AS l FROM blocks WHERE kind = 'text'))) WHERE x <> '' AND length(x) < 20 AND NOT starts_with(x, '#') GROUP BY 1),
rn AS (SELECT b.doc_id, b.body, coalesce(nullif(r.short, ''), nullif(b.title, ''), '未知菜谱') AS name FROM bodies b LEFT JOIN rname r USING (doc_id)),
ru AS (SELECT doc_id, block, 0 AS i, flat AS u, true AS s FROM bt WHERE flat <> '' AND regexp_matches({STRIP.format('flat')}, {rx(H.RECIPE_STEP)}) UNION ALL SELECT doc_id, block, i, {STRIP.format('l[i]')} AS u, regexp_matches({STRIP.format('l[i]')}, {rx(H.RECIPE_STEP)}) FROM (SELECT doc_id, block, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, block, string_split(flat, chr(10)) AS l FROM bt WHERE flat <> '' AND NOT regexp_matches({STRIP.format('flat')}, {rx(H.RECIPE_STEP)}))) WHERE {STRIP.format('l[i]')} <> ''),
rr AS (SELECT *, sum(s::int) OVER (PARTITION BY doc_id ORDER BY block, i) AS run FROM ru),
rc0 AS (SELECT doc_id, 'recipe_step' AS chunk_type, {STRIP.format("string_agg(u, chr(10) ORDER BY block, i)")} AS content FROM rr GROUP BY doc_id, run
 UNION ALL SELECT doc_id, 'recipe_basic', string_agg(flat, {NL2} ORDER BY block) FROM bt WHERE {_any('flat', H.RECIPE_INFO)} GROUP BY 1
 UNION ALL SELECT doc_id, 'recipe_ingredients', string_agg(flat, {NL2} ORDER BY block) FROM bt WHERE {_any('flat', H.RECIPE_INGREDIENTS)} GROUP BY 1),
recipe AS (SELECT doc_id, chunk_type, content, name AS label FROM rc0 JOIN rn USING (doc_id) WHERE content <> '' UNION ALL SELECT doc_id, 'recipe_full', body, name FROM rn WHERE doc_id NOT IN (SELECT doc_id FROM rc0) AND body <> '')"""
ALL_NUTRIENTS = [n for t in H.NUTRIENTS.values() for n in t]
NUTRITION = f"""nt AS (SELECT doc_id, CASE {" ".join(f"WHEN {_any('h', t)} THEN '{k}'" for k, t in H.NUTRIENTS.items())} ELSE 'macro' END AS kind, txt FROM (SELECT doc_id, txt, concat_ws(' ', array_to_string(headers, ' '), array_to_string(list_transform(rows[1:5], lambda r: array_to_string(r, ' ')), ' ')) AS h FROM bt WHERE kind = 'table')),
nx AS (SELECT doc_id, string_agg(content, {NL2} ORDER BY block) AS t FROM bt WHERE kind = 'list' OR (kind = 'text' AND {_any('content', ALL_NUTRIENTS)}) GROUP BY 1),
nutrition AS (SELECT doc_id, 'nutrition_' || kind AS chunk_type, txt AS content, kind AS label FROM nt UNION ALL SELECT doc_id, 'nutrition_text', t, '' FROM nx WHERE floor(length(t) * 0.7::double) <= 512 UNION ALL SELECT doc_id, 'nutrition_text', p, '' FROM (SELECT doc_id, unnest(string_split(regexp_replace(t, '({H.NUTRIENT_SPLIT})', chr(1) || '\\1', 'g'), chr(1))) AS p FROM nx WHERE floor(length(t) * 0.7::double) > 512) WHERE NOT regexp_full_match(p, '\\s*'))"""
MEDICAL = f"""ml AS (SELECT doc_id, body, {" || '|' || ".join(f"coalesce(array_to_string(list_filter({sql_list(t)}, lambda x: contains(body, x)), ','), '')" for t in (H.CONDITIONS, H.CROWDS))} AS label FROM bodies),
ms AS (SELECT doc_id, 'medical_' || CASE {" ".join(f"WHEN {_any('content', t)} THEN '{k}'" for k, t in H.ADVICE.items())} ELSE 'general' END AS chunk_type, block, content FROM bt WHERE kind = 'text'),
mc AS (SELECT doc_id, chunk_type, string_agg(content, {NL2} ORDER BY block) AS content FROM ms GROUP BY ALL),
medical AS (SELECT doc_id, chunk_type, content, label FROM mc JOIN ml USING (doc_id) UNION ALL SELECT doc_id, 'medical_general', body, label FROM ml WHERE doc_id NOT IN (SELECT doc_id FROM mc) AND body <> '')"""
PERSONAL = f"""pu AS (SELECT doc_id, body, coalesce({", ".join(f"nullif(regexp_extract(body, {rx(p)}, 1), '')" for p in H.USER_ID)}, substr(doc_id::varchar, 1, 8)) AS label FROM bodies),
pm AS (SELECT doc_id, block, content, CASE {" ".join(f"WHEN {_any('content', t)} THEN '{k}'" for k, t in H.PERSONAL.items())} END AS m FROM bt WHERE kind = 'text'),
ps AS (SELECT doc_id, block, content, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'profile') AS m FROM pm),
pc AS (SELECT doc_id, 'personal_' || m AS chunk_type, string_agg(content, chr(10) ORDER BY block) AS content FROM ps GROUP BY doc_id, m),
personal AS (SELECT doc_id, chunk_type, content, label FROM pc JOIN pu USING (doc_id) UNION ALL SELECT doc_id, 'personal_profile', body, label FROM pu WHERE doc_id NOT IN (SELECT doc_id FROM pc) AND body <> '')"""
def _date(col: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({col}, {rx(p)}, {1 if '天' in p else 0}), '')" for p in H.DATES) + ")"


DAILY = f"""dd AS (SELECT bt.doc_id, block, flat, coalesce({_date('flat')}, {_date('body')}, '{TODAY}') AS date FROM bt JOIN bodies USING (doc_id) WHERE flat <> ''),
daily AS (SELECT doc_id, date, string_agg(flat, chr(10) ORDER BY block) AS content FROM dd GROUP BY ALL)"""
FACT_ROWS = f"""ent AS (SELECT doc_id, text, coalesce({", ".join(f"CASE WHEN regexp_extract(text, {rx(p)}, 1) NOT IN ({', '.join(map(sql_text, G.NO_ENTITY))}, '') THEN regexp_extract(text, {rx(p)}, 1) END" for p in G.ENTITY)}) AS entity FROM notes),
fl AS (SELECT doc_id, entity, list_concat(list_concat(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, {rx(p)}) THEN {{'attr': '{a}', 'value': regexp_extract(text, {rx(p)}, 1) || regexp_extract(text, {rx(p)}, 2), 'confidence': 0.9::double}} END" for a, p in G.AMOUNTS.items())}], lambda x: x IS NOT NULL),
 {"), ".join(f"list_transform(regexp_extract_all(text, {rx(p)}, 1), lambda v: {{'attr': '{a}', 'value': regexp_replace(v, '^\\s+|\\s+$', '', 'g'), 'confidence': 0.75::double}})" for a, p in G.QUALITIES.items())}) AS l FROM ent WHERE entity IS NOT NULL),
facts AS (SELECT doc_id, entity, i::int - 1 AS seq, l[i].attr AS attr, l[i].value AS value, l[i].confidence AS confidence FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM fl))"""
ATTRIBUTE_ROWS = f"attrs AS (SELECT p_brand AS entity, {sql_list(ATTRS)}[p_partkey % {len(ATTRS)} + 1] AS attr, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN p_name ELSE concat_ws(' ', p_name, 'Brand#' || (p_partkey % 50 + 10)) END AS value, p_size / 50.0::double AS confidence, p_partkey AS seq FROM part)"
RELATION = "CASE " + " ".join(f"WHEN contains(attr, '{k}') THEN '{v}'" for k, v in G.RELATIONS.items()) + " END"
OBJECT = "CASE r " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.OBJECT_TYPES.items()) + " ELSE 'unknown' END"
LITERAL = "CASE " + " ".join(f"WHEN {_any('attr', t)} THEN '{k}'" for k, t in G.LITERAL_TYPES.items()) + " ELSE 'property' END"
OUT = "doc_id, chunk_type, md5(content) AS content_md5, label"
VALID_TEXT = "regexp_replace(text, '[^" + VALID[1:].replace("'", "''") + "', '', 'g')"

_SENTENCES = "regexp_extract_all({c}, '[^。！？；\\n]*[。！？；\\n]|[^。！？；\\n]+')"
_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_N = "floor(length({c}) * 0.7::double)::int"
_CUT = "list_transform(range(0, (length({c}) - 1) // 358 + 1), lambda i: substr({c}, (i * 358 + 1)::int, 358))"


def similarity_sql(source: str) -> str:
    """CTEs from source(doc_id, block, content) to sp(doc_id, block, part, content)."""
    key = "doc_id, block"
    return f"""s0 AS (SELECT {key}, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT {key}, {_SENTENCES.format(c='content')} AS l FROM {source})),
s1 AS (SELECT {key}, {_STRIP.format(c='s')} AS s, i FROM s0),
s2 AS (SELECT {key}, s, row_number() OVER (PARTITION BY {key} ORDER BY i) AS k FROM s1 WHERE s <> ''),
tk AS (SELECT {key}, k, md5(unnest(CASE WHEN len(w) > 0 THEN w ELSE [s] END)) AS h FROM (SELECT *, regexp_extract_all(s, '[A-Za-z]+|[一-鿿]') AS w FROM s2)),
vc AS (SELECT {key}, k, ('0x' || substr(h, 1, 8))::bigint % 384 AS x, sum(1 - 2 * (('0x' || substr(h, 9, 2))::bigint % 2)) AS w FROM tk GROUP BY ALL),
nr AS (SELECT {key}, k, sum(w * w)::double AS n FROM vc GROUP BY ALL),
dt AS (SELECT b.doc_id, b.block, b.k, sum(a.w * b.w)::double AS d FROM vc a JOIN vc b ON a.doc_id = b.doc_id AND a.block = b.block AND a.k = b.k - 1 AND a.x = b.x GROUP BY ALL),
br AS (SELECT s2.*, s2.k = 1 OR coalesce(d / nullif(sqrt(a.n * b.n), 0), 0) < 0.5 AS cut FROM s2 LEFT JOIN dt USING ({key}, k) LEFT JOIN nr b USING ({key}, k) LEFT JOIN nr a ON a.doc_id = s2.doc_id AND a.block = s2.block AND a.k = s2.k - 1),
g0 AS (SELECT *, sum(cut::int) OVER (PARTITION BY {key} ORDER BY k) AS g, count(*) OVER (PARTITION BY {key}) AS many FROM br),
g1 AS (SELECT {key}, g, many, string_agg(s, '' ORDER BY k) AS c FROM g0 GROUP BY ALL),
g2 AS (SELECT *, {_N.format(c='c')} AS n FROM g1),
g3 AS (SELECT *, sum((g = 1 OR n >= 100)::int) OVER (PARTITION BY {key} ORDER BY g) AS p FROM g2),
g4 AS (SELECT {key}, p, many, arg_min(c, g) AS c, arg_min(n, g) AS n, coalesce(substr(string_agg(c, '' ORDER BY g), (length(arg_min(c, g)) + 1)::int), '') AS more FROM g3 GROUP BY ALL),
g5 AS (SELECT {key}, p, more, CASE WHEN n > 512 AND many > 1 THEN {_CUT.format(c='c')} ELSE [c] END AS l FROM g4),
g6 AS (SELECT {key}, p, unnest(l) AS c, generate_subscripts(l, 1) AS i, len(l) AS last, more FROM g5),
g7 AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY p, i) AS part, CASE WHEN i = last THEN c || more ELSE c END AS c FROM g6),
t0 AS (SELECT {key}, part, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT {key}, part, {_SENTENCES.format(c='c')} AS l FROM g7)),
t1 AS (SELECT {key}, part, i, {_STRIP.format(c='s')} AS s FROM t0),
t2 AS (SELECT *, sum({_N.format(c='s')}) OVER (PARTITION BY {key}, part ORDER BY i DESC) AS used FROM t1 WHERE s <> ''),
t3 AS (SELECT {key}, part + 1 AS part, string_agg(s, '' ORDER BY i) AS head FROM t2 WHERE used <= 50 GROUP BY ALL),
sp AS (SELECT {key}, part - 1 AS part, coalesce(head, '') || c AS content FROM g7 LEFT JOIN t3 USING ({key}, part))"""


_PLAIN = "src AS (SELECT doc_id, block, content FROM blocks WHERE kind <> 'table')"
CLAUSES = f"""s0 AS (SELECT doc_id, block, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, block, {_SENTENCES.format(c='content')} AS l FROM src)),
s1 AS (SELECT doc_id, block, i, {_STRIP.format(c='s')} AS s FROM s0),
c0 AS (SELECT doc_id, block, i, unnest(l) AS c, generate_subscripts(l, 1) AS j FROM (SELECT *, regexp_extract_all(s, '[^，、；：]*[，、；：]|[^，、；：]+') AS l FROM s1 WHERE s <> '')),
c1 AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY i, j) AS k, c FROM (SELECT doc_id, block, i, j, {_STRIP.format(c='c')} AS c FROM c0) WHERE c <> ''),
c2 AS (SELECT *, sum((k = 1 OR NOT regexp_matches(c, '^(?:{H.CONTINUES})'))::int) OVER (PARTITION BY doc_id, block ORDER BY k) AS u FROM c1),
un AS (SELECT doc_id, block, u, string_agg(c, '，' ORDER BY k) AS t FROM c2 GROUP BY ALL),
u2 AS (SELECT *, {_N.format(c='t')} AS n FROM un),
pk AS (SELECT DISTINCT doc_id, block, 0::hugeint AS u, []::varchar[] AS parts, []::varchar[] AS held, 0::bigint AS used FROM u2
  UNION ALL SELECT pk.doc_id, pk.block, u2.u,
    CASE WHEN n > 512 THEN parts || CASE WHEN len(held) > 0 THEN [array_to_string(held, '')] ELSE []::varchar[] END || {_CUT.format(c='t')} WHEN used + n > 512 THEN parts || [array_to_string(held, '')] ELSE parts END,
    CASE WHEN n > 512 THEN []::varchar[] WHEN used + n > 512 THEN list_filter(held, lambda x, i: list_sum(list_transform(held[i:], lambda y: {_N.format(c='y')})) <= 50) || [t] ELSE held || [t] END,
    CASE WHEN n > 512 THEN 0 WHEN used + n > 512 THEN coalesce(list_sum(list_transform(list_filter(held, lambda x, i: list_sum(list_transform(held[i:], lambda y: {_N.format(c='y')})) <= 50), lambda y: {_N.format(c='y')})), 0) + n ELSE used + n END
  FROM pk JOIN u2 ON u2.doc_id = pk.doc_id AND u2.block = pk.block AND u2.u = pk.u + 1),
fn AS (SELECT doc_id, block, arg_max(parts, u) || CASE WHEN len(arg_max(held, u)) > 0 THEN [array_to_string(arg_max(held, u), '')] ELSE []::varchar[] END AS l FROM pk GROUP BY ALL),
f1 AS (SELECT doc_id, block, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM fn),
f2 AS (SELECT *, sum((i = 1 OR {_N.format(c='c')} >= 80)::int) OVER (PARTITION BY doc_id, block ORDER BY i) AS p FROM f1),
cp AS (SELECT doc_id, block, (p - 1)::int AS part, string_agg(c, '' ORDER BY i) AS content FROM f2 GROUP BY ALL)"""

SQL = {
    "h4_similarity_parts": f"WITH {BLOCKS}, {_PLAIN}, {similarity_sql('src')}, n AS (SELECT *, {_N.format(c='content')} AS n FROM sp) SELECT doc_id, (block - 1)::int AS block, part::int AS part, md5(content) AS content_md5, CASE WHEN n < 50 THEN 'poor' WHEN n > 1000 THEN 'fair' WHEN n BETWEEN 100 AND 512 THEN 'excellent' ELSE 'good' END AS grade FROM n",
    "h5_clause_parts": f"WITH RECURSIVE {BLOCKS}, {_PLAIN}, {CLAUSES} SELECT doc_id, (block - 1)::int AS block, part, md5(content) AS content_md5 FROM cp",
    "h11_split_long": f"WITH {NOTES_SQL}, src AS (SELECT doc_id, 0 AS block, text AS content FROM notes WHERE {_N.format(c='text')} > 512), {similarity_sql('src')} SELECT doc_id, part::int AS part, md5(content) AS content_md5 FROM sp UNION ALL SELECT doc_id, 0, md5(text) FROM notes WHERE {_N.format(c='text')} <= 512",
    "p2_p9_tables": f"WITH {BLOCKS}, c AS (SELECT doc_id, block, headers, rows, txt, list_filter(rows, lambda r: len(list_filter(r, lambda x: x <> '')) > 0) AS kept FROM bt WHERE kind = 'table') SELECT doc_id, block, array_to_string(headers, '|') AS headers, len(rows) AS n_rows, txt AS text, CASE WHEN len(kept) > 0 OR len(headers) > 0 THEN array_to_string(list_concat(CASE WHEN len(headers) > 0 THEN [array_to_string(list_transform(headers, lambda x: regexp_replace(x, '\\s+', ' ', 'g')), ' | ')] ELSE [] END, list_transform(kept, lambda r: array_to_string(list_transform(r, lambda x: regexp_replace(x, '\\s+', ' ', 'g')), ' | '))), chr(10)) END AS clean FROM c",
    "p3_p4_document_text": f"WITH {BLOCKS} SELECT doc_id, title, md5(body) AS body_md5 FROM bodies",
    "p10_images": f"WITH c AS (SELECT doc_id, source, text, {VALID_TEXT} AS clean FROM documents), d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {STRIP.format('source')} END AS description, CASE WHEN doc_id % 4 = 0 THEN {STRIP.format('''CASE WHEN (length(text) - length(clean)) / length(text)::double > 0.3 THEN '' ELSE clean END''')} END AS ocr FROM c) SELECT doc_id, description, md5(ocr) AS ocr_md5 FROM d WHERE coalesce(description, '') <> '' OR coalesce(ocr, '') <> '' OR doc_id % 5 = 0",
    "c1_c6_c15_classify": f"WITH {CLASSES} SELECT doc_id, category, confidence, secondary, CASE WHEN coalesce(strong = category, false) THEN 'rule_strong' ELSE 'rule' END AS method, scores, length({STRIP.format('body')}) >= 100 AND (category = 'unknown' OR confidence < 0.45 OR margin < 2) AS needs_model FROM classes",
    "h6_recipe_chunks": f"WITH {BLOCKS}, {RECIPE} SELECT {OUT} FROM recipe",
    "h7_nutrition_chunks": f"WITH {BLOCKS}, {NUTRITION} SELECT {OUT} FROM nutrition",
    "h8_medical_chunks": f"WITH {BLOCKS}, {MEDICAL} SELECT {OUT} FROM medical",
    "h9_daily_chunks": f"WITH {BLOCKS}, {DAILY} SELECT doc_id, date, md5(content) AS content_md5, concat_ws(',', {', '.join(f'''CASE WHEN contains(content, '{k}') THEN '{v}' END''' for k, v in H.MEALS.items())}) AS meals FROM daily",
    "h10_personal_chunks": f"WITH {BLOCKS}, {PERSONAL} SELECT {OUT} FROM personal",
    "h1_h3_chunk_by_category": f"WITH {CLASSES}, {RECIPE}, {NUTRITION}, {MEDICAL}, {PERSONAL}, {DAILY}, every AS (SELECT 'recipe' AS c, * FROM recipe UNION ALL SELECT 'nutrition', * FROM nutrition UNION ALL SELECT 'medical', * FROM medical UNION ALL SELECT 'personal', * FROM personal UNION ALL SELECT 'daily', doc_id, 'daily_record', content, date FROM daily UNION ALL SELECT 'unknown', doc_id, kind, txt, '' FROM bt) SELECT {OUT}, CASE WHEN chunk_type IN ('table', 'list') THEN chunk_type WHEN chunk_type = 'recipe_step' THEN 'step' ELSE 'text' END AS display_format FROM every JOIN classes k USING (doc_id) WHERE c = k.category",
    "g2_rule_facts": f"WITH {NOTES_SQL}, {FACT_ROWS} SELECT * FROM facts",
    "g3_merge_facts": f"WITH {NOTES_SQL}, {FACT_ROWS}, s AS (SELECT *, min(doc_id) OVER (PARTITION BY entity) AS f, max(doc_id) OVER (PARTITION BY entity) AS l, row_number() OVER (PARTITION BY entity, attr, doc_id ORDER BY seq DESC) AS back FROM facts) SELECT entity, attr, value, confidence FROM s WHERE f = l UNION ALL SELECT entity, attr, value, confidence FROM (SELECT * FROM s WHERE f < l AND (doc_id > f OR back = 1) QUALIFY row_number() OVER (PARTITION BY entity, attr ORDER BY confidence DESC, doc_id, seq) = 1)",
    "g4_measures": f"WITH {NOTES_SQL}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, {rx(G.MEASURE)}, 1)) AS name, unnest(regexp_extract_all(text, {rx(G.MEASURE)}, 2)) AS amount, unnest(list_transform(regexp_extract_all(text, {rx(G.MEASURE)}, 3), lambda u: coalesce(u, ''))) AS unit FROM notes), l AS (SELECT doc_id, regexp_replace({STRIP.format('x')}, '^[- ]+', '') AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM notes)), i AS (SELECT doc_id, list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '') AS w FROM l WHERE x <> '' AND length(x) < 30) SELECT doc_id, name, amount, unit, count(*) AS n FROM (SELECT * FROM m UNION ALL SELECT doc_id, w[1], coalesce(array_to_string(w[2:], ' '), ''), 'line' FROM i WHERE len(w) > 0) GROUP BY ALL",
    "g5_first_values": f"WITH {ATTRIBUTE_ROWS} SELECT entity, attr, min_by(value, seq) AS value FROM attrs WHERE value <> '' GROUP BY ALL",
    "g6_g8_fact_triples": f"WITH {ATTRIBUTE_ROWS}, r AS (SELECT *, {RELATION} AS r FROM attrs WHERE value <> ''), k AS (SELECT DISTINCT entity AS n FROM attrs), j AS (SELECT r.*, n FROM r LEFT JOIN k ON contains(value, n) WHERE r IS NOT NULL) SELECT entity AS subject, coalesce(r, attr) AS predicate, substr(value, 1, 100) AS object, {LITERAL} AS object_type, round(confidence, 6) AS confidence, seq FROM r WHERE r IS NULL UNION ALL SELECT entity, r, coalesce(n, substr(value, 1, 100)), CASE WHEN n IS NULL THEN 'description' ELSE {OBJECT} END, round(confidence, 6), seq FROM j",
    "g7_attribute_shapes": "SELECT p_partkey, unnest(['name', 'brand']) AS attr, unnest([p_name, p_brand]) AS value, unnest([0.5::double, 0.8]) AS confidence FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, unnest(['tags', 'size', 'type']), unnest([p_brand || '、' || p_type, p_size::varchar, 'food']), 0.6 FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, unnest(['amount', 'unit']), unnest([p_size::varchar, 'g']), 0.8 FROM part WHERE p_partkey % 3 = 2",
    "g9_g10_text_triples": f"WITH {NOTES_SQL}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, {rx(G.CONFLICT)}, 1)) AS subject, 'conflicts_with' AS predicate, unnest(regexp_extract_all(text, {rx(G.CONFLICT)}, 2)) AS object FROM notes WHERE length(text) >= 20 UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, {rx(G.REPLACE)}, 1)), 'can_replace', unnest(regexp_extract_all(text, {rx(G.REPLACE)}, 2)) FROM notes WHERE length(text) >= 20) SELECT subject, predicate, object, min(doc_id) AS doc_id FROM t GROUP BY ALL",
    "g11_user_content": f"WITH {SIGNALS} SELECT request_id, concat_ws(':', 'user_content', user_id, ctype, substr(sha256(query), 1, 12)) AS source_doc_id, CASE ctype {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in G.CONTENT_CATEGORIES.items())} END AS doc_category, ctype AS content_type FROM sig WHERE ctype IS NOT NULL",
}
QUERIES = {f.__name__: f for f in (p2_p9_tables, p3_p4_document_text, p10_images, c1_c6_c15_classify, h6_recipe_chunks, h7_nutrition_chunks, h8_medical_chunks, h9_daily_chunks, h10_personal_chunks, h1_h3_chunk_by_category, h4_similarity_parts, h5_clause_parts, h11_split_long, g2_rule_facts, g3_merge_facts, g4_measures, g5_first_values, g6_g8_fact_triples, g7_attribute_shapes, g9_g10_text_triples, g11_user_content)}
