"""Queries of graph, memory, evidence and evaluation over the test tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import evidence as A
from ..operators import graph as G
from ..operators import memory as M
from ..sources.tables import ATTRIBUTES_SQL, TRIPLES_SQL, attributes, table, triples

HOT, WARM = 2, 3
ENTITIES = ("supplier_1", "supplier_2", "nation_3")
SOURCES = {"click": 10, "view": 15, "purchase": 10}
WEIGHTS = {"click": 1.15, "view": 1.05, "purchase": 0.95}
FORBIDDEN = ("peanut", "tion", "gift")


def _entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ENTITIES], "entity string")


def n1_canonical_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", G.canonical_id(F.col("p_name")).alias("plain"), G.canonical_id(F.col("p_type"), "type").alias("prefixed"))


def r1_alias_resolve(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    aliases = part.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("entity"), F.col("p_name").alias("alias"), (F.col("p_size") / 50.0).alias("confidence"), F.col("p_partkey").alias("id"))
    return G.resolve_alias(aliases, part.select(F.col("p_name").alias("name")))


def r4_triples_of(spark: SparkSession, sf: str) -> DataFrame:
    return G.triples_of(triples(spark, sf), _entities(spark)).select(*G.SPO)


def r5_triples_distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    return G.first_triples(triples(spark, sf))


def r7_entity_report(spark: SparkSession, sf: str) -> DataFrame:
    return G.entity_report(attributes(spark, sf), triples(spark, sf))


def r8_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    return G.one_hop(triples(spark, sf), _entities(spark), allowed=["supplies", "located_in"])


def r10_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbours(triples(spark, sf), _entities(spark))


def k4_alias_upsert(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_brand").alias("entity"), F.col("p_name").alias("alias"), F.col("p_type").alias("source"), (F.col("p_size") / 50.0).alias("confidence"), F.col("p_partkey").alias("seq"))
    return G.upsert_aliases(part.where("seq % 2 = 0"), part.where("seq % 2 = 1"))


def k5_log_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return G.upsert_logs(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id"], ["value", "props"])


def r12_tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    return m1_conversation_tiers(spark, sf).groupBy("tier").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("sessions"))


def m1_conversation_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return M.tiers(table(spark, sf, "conversations"), "conv_id", ["turn", "role", "text"], HOT, WARM).select("conv_id", "turn", "role", "tier")


def m5_tail_within(spark: SparkSession, sf: str) -> DataFrame:
    return M.tail_within(table(spark, sf, "conversations"), "conv_id", ["turn", "role", "text"], "text", 800).select("conv_id", "turn", "role")


def m8_context(spark: SparkSession, sf: str) -> DataFrame:
    return M.context(table(spark, sf, "conversations"), "conv_id", ["turn", "role", "text"], "role", "text", HOT, WARM, 1200)


def m9_retention(spark: SparkSession, sf: str) -> DataFrame:
    t = M.tiers(table(spark, sf, "conversations"), "conv_id", ["turn", "role", "text"], HOT, WARM)
    return M.retain(t, "conv_id", ["turn", "role", "text"], 6).select("conv_id", "turn", "role", "tier")


def a1_source_caps(spark: SparkSession, sf: str) -> DataFrame:
    return A.cap_per_source(table(spark, sf, "events"), "user_id", "event_type", "value", "event_id", SOURCES).select("event_id", "user_id", "event_type", "rank")


def a3_tenant_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("doc", F.when(F.col("event_type") == "click", F.concat_ws(":", F.lit("user_content"), F.col("user_id").cast("string"), F.lit("note"), F.col("event_id").cast("string"))).otherwise("public"))
    return A.tenant_rows(e, "doc", F.lit("1")).select("event_id", "doc")


def a5_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(A.weighted(F.col("value"), F.col("event_type"), WEIGHTS), 6).alias("score"))


def a9_safety(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.flag_unsafe(table(spark, sf, "documents").withColumn("score", F.lit(1.0)), "text", "score", list(FORBIDDEN))
    return rows.select("doc_id", F.concat_ws(",", "hits").alias("hits"), F.round("score", 6).alias("score"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf, "conversations").withColumn("previous", F.lag("text").over(w)).where("previous is not null")


def e1_set_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = _answers(spark, sf).withColumn("_s", E.set_scores(E.lexical_tokens(F.col("text")), E.lexical_tokens(F.col("previous"))))
    return s.select("conv_id", "turn", *(F.round(f"_s.{m}", 6).alias(m) for m in ("precision", "recall", "f1")))


def e4_lexical_f1(spark: SparkSession, sf: str) -> DataFrame:
    return E.lexical_f1(_answers(spark, sf), ["conv_id", "turn"], "text", "previous").select("conv_id", "turn", F.round("lexical_f1", 6).alias("lexical_f1"))


def e18_repetition(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("conv_id", "turn", F.round(E.repetition(F.col("previous"), F.col("text")), 6).alias("repetition"))


def _means(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    return E.averages(e1_set_scores(spark, sf).where(where), ["precision", "recall", "f1"])


def e12_averages(spark: SparkSession, sf: str) -> DataFrame:
    return _means(spark, sf).select("metric", F.round("mean", 6).alias("mean"), "example_count")


def e13_compare(spark: SparkSession, sf: str) -> DataFrame:
    return E.compare(_means(spark, sf, "conv_id % 2 = 0"), _means(spark, sf, "conv_id % 2 = 1")).select("metric", F.round("diff", 4).alias("diff"), "verdict")


def s17_counts(spark: SparkSession, sf: str) -> DataFrame:
    one = [table(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("documents", "conversations", "events")]
    return one[0].union(one[1]).union(one[2])


FIRST = f"""{TRIPLES_SQL},
first AS (SELECT subject, predicate, object, confidence, seq FROM triples QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY confidence DESC, seq) = 1)"""
NAMES = ", ".join(f"'{x}'" for x in ENTITIES)
NEAR = f"""{FIRST},
near AS (SELECT * FROM first WHERE subject IN ({NAMES}) OR object IN ({NAMES}))"""
TIER = f"""r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations),
tiers AS (SELECT conv_id, turn, role, text, CASE WHEN r <= {HOT} THEN 'hot' WHEN r <= {HOT + WARM} THEN 'warm' ELSE 'cold' END AS tier FROM r)"""
TAIL = """(SELECT * FROM (SELECT *, sum(floor(length(coalesce({c}, '')) * 0.7::double)::int) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM {t}) WHERE s <= {b} OR rn = 1)"""
ANSWERS = "answers AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS previous FROM conversations) WHERE previous IS NOT NULL)"
LEX = "regexp_extract_all(lower(coalesce({c}, '')), '[\\x{{4e00}}-\\x{{9fff}}]|[a-z0-9_]+')"
SETS = f"""{ANSWERS},
t AS (SELECT conv_id, turn, list_distinct({LEX.format(c="text")}) AS a, list_distinct({LEX.format(c="previous")}) AS b FROM answers),
n AS (SELECT conv_id, turn, len(a)::double AS na, len(b)::double AS nb, len(list_intersect(a, b))::double AS k FROM t),
pr AS (SELECT conv_id, turn, CASE WHEN na > 0 THEN k / na ELSE 0 END AS p, CASE WHEN nb > 0 THEN k / nb ELSE 0 END AS r FROM n),
scores AS (SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr),
long AS (SELECT conv_id, 'precision' AS metric, precision AS v FROM scores UNION ALL SELECT conv_id, 'recall', recall FROM scores UNION ALL SELECT conv_id, 'f1', f1 FROM scores)"""
GRAMS = "list_distinct(list_transform(range(1, greatest(length({c}) - 9, 0) + 1), lambda i: substr({c}, i, 10)))"
CAP = " ".join(f"WHEN '{k}' THEN {n}" for k, n in SOURCES.items())
WEIGHT = " ".join(f"WHEN '{k}' THEN {n}::double" for k, n in WEIGHTS.items())
HITS = ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{x}') THEN '{x}' END" for x in FORBIDDEN)

SQL = {
    "n1_canonical_id": r"WITH s AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(coalesce(p_name, '')), '[^\p{L}\p{N}_]+', '_', 'g'), '_+', '_', 'g'), '_') AS a, trim(regexp_replace(regexp_replace(lower(coalesce(p_type, '')), '[^\p{L}\p{N}_]+', '_', 'g'), '_+', '_', 'g'), '_') AS b FROM part) SELECT p_partkey, CASE WHEN a = '' THEN 'unknown' ELSE a END AS plain, CASE WHEN starts_with(b, 'type_') THEN b ELSE 'type_' || b END AS prefixed FROM s",
    "r1_alias_resolve": "SELECT p_name AS name, 'part_' || p_partkey AS entity FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) = 1",
    "r4_triples_of": f"WITH {TRIPLES_SQL} SELECT subject, predicate, object FROM triples WHERE subject IN ({NAMES}) OR object IN ({NAMES})",
    "r5_triples_distinct_on": f"WITH {FIRST} SELECT * FROM first",
    "r7_entity_report": f"WITH {ATTRIBUTES_SQL}, {FIRST} SELECT entity, count(DISTINCT attribute) AS n_attributes, max_by(value, seq) FILTER (WHERE attribute = 'name') AS name, (SELECT count(*) FROM first WHERE subject = entity) AS n_out, (SELECT count(*) FROM first WHERE object = entity) AS n_in FROM attributes GROUP BY entity",
    "r8_one_hop": f"WITH {NEAR}, n AS (SELECT * FROM near ORDER BY confidence DESC, subject, predicate, object LIMIT 80), e AS (SELECT DISTINCT x FROM (SELECT subject AS x FROM n UNION ALL SELECT object FROM n) WHERE x NOT IN ({NAMES}) ORDER BY x LIMIT 5), f AS (SELECT * FROM first WHERE (subject IN (SELECT x FROM e) OR object IN (SELECT x FROM e)) AND predicate IN ('supplies', 'located_in') AND (subject, predicate, object) NOT IN (SELECT (subject, predicate, object) FROM n) ORDER BY confidence DESC, subject, predicate, object LIMIT 30) SELECT subject, predicate, object, 0 AS hop FROM n UNION ALL SELECT subject, predicate, object, 1 FROM f",
    "r10_neighbours": f"WITH {NEAR} SELECT DISTINCT x AS entity FROM (SELECT subject AS x FROM near UNION ALL SELECT object FROM near) WHERE x NOT IN ({NAMES})",
    "k4_alias_upsert": "SELECT p_brand AS entity, p_name AS alias, max_by(p_type, p_partkey) AS source, max(p_size / 50.0::double) AS confidence, max(p_partkey) AS seq FROM part GROUP BY 1, 2",
    "k5_log_upsert": "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1, 2",
    "r12_tier_counts": f"WITH {TIER} SELECT tier, count(*) AS turns, count(DISTINCT conv_id) AS sessions FROM tiers GROUP BY 1",
    "m1_conversation_tiers": f"WITH {TIER} SELECT conv_id, turn, role, tier FROM tiers",
    "m5_tail_within": f"SELECT conv_id, turn, role FROM {TAIL.format(c='text', t='conversations', b=800)}",
    "m8_context": f"""WITH {TIER}, l AS (SELECT *, role || ': ' || regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g') AS full_line, role || ': ' || substr(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g'), 1, 240) AS short_line FROM tiers),
h AS (SELECT conv_id, string_agg(full_line, chr(10) ORDER BY turn, role, text) AS x FROM {TAIL.format(c="full_line", t="(SELECT * FROM l WHERE tier = 'hot')", b=1200)} GROUP BY 1),
w AS (SELECT conv_id, string_agg(short_line, chr(10) ORDER BY turn, role, text) AS x FROM {TAIL.format(c="short_line", t="(SELECT * FROM l WHERE tier = 'warm')", b=400)} GROUP BY 1)
SELECT h.conv_id, concat_ws(chr(10), w.x, h.x) AS context FROM h LEFT JOIN w USING (conv_id)""",
    "m9_retention": f"WITH {TIER}, n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, tier ORDER BY turn, role, text) AS k FROM tiers) SELECT conv_id, turn, role, tier FROM n WHERE tier <> 'cold' OR k > n - 6",
    "a1_source_caps": f"SELECT event_id, user_id, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id)::int AS rank FROM events) WHERE rank <= CASE event_type {CAP} ELSE 10 END",
    "a3_tenant_rows": "SELECT event_id, CASE WHEN event_type = 'click' THEN 'user_content:' || user_id || ':note:' || event_id ELSE 'public' END AS doc FROM events WHERE event_type IS DISTINCT FROM 'click' OR user_id = 1",
    "a5_weighted": f"SELECT event_id, round(coalesce(value, 0) * CASE event_type {WEIGHT} ELSE 1.0::double END, 6) AS score FROM events",
    "a9_safety": f"WITH h AS (SELECT doc_id, concat_ws(',', {HITS}) AS hits FROM documents) SELECT doc_id, hits, CASE WHEN hits = '' THEN 1.0::double ELSE 0.3::double END AS score FROM h",
    "e1_set_scores": f"WITH {SETS} SELECT * FROM scores",
    "e4_lexical_f1": f"WITH {ANSWERS}, a AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest({LEX.format(c='text')}) AS t FROM answers) GROUP BY ALL), b AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest({LEX.format(c='previous')}) AS t FROM answers) GROUP BY ALL), k AS (SELECT a.conv_id, a.turn, sum(least(a.n, b.n)) AS k FROM a JOIN b USING (conv_id, turn, t) GROUP BY ALL) SELECT x.conv_id, x.turn, round(coalesce(2 * k / nullif(len({LEX.format(c='text')}) + len({LEX.format(c='previous')}), 0)::double, 0), 6) AS lexical_f1 FROM answers x LEFT JOIN k USING (conv_id, turn)",
    "e18_repetition": f"WITH {ANSWERS}, s AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', '', 'g') AS x, regexp_replace(coalesce(previous, ''), '[ \\t\\n\\r]+', '', 'g') AS y FROM answers), g AS (SELECT conv_id, turn, {GRAMS.format(c='x')} AS a, {GRAMS.format(c='y')} AS b FROM s), n AS (SELECT conv_id, turn, len(list_intersect(a, b))::double AS k, len(a) + len(b) AS n FROM g) SELECT conv_id, turn, round(CASE WHEN n - k > 0 THEN 1 - k / (n - k) ELSE 1 END, 6) AS repetition FROM n",
    "e12_averages": f"WITH {SETS} SELECT metric, round(avg(v), 6) AS mean, count(*) AS example_count FROM long GROUP BY 1",
    "e13_compare": f"WITH {SETS}, d AS (SELECT metric, round(avg(v) FILTER (WHERE conv_id % 2 = 1) - avg(v) FILTER (WHERE conv_id % 2 = 0), 4) AS diff FROM long GROUP BY 1) SELECT metric, diff, CASE WHEN diff > 0 THEN 'improved' WHEN diff < 0 THEN 'regressed' ELSE 'unchanged' END AS verdict FROM d",
    "s17_counts": "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events",
}
QUERIES = {f.__name__: f for f in (n1_canonical_id, r1_alias_resolve, r4_triples_of, r5_triples_distinct_on, r7_entity_report, r8_one_hop, r10_neighbours, k4_alias_upsert, k5_log_upsert, r12_tier_counts, m1_conversation_tiers, m5_tail_within, m8_context, m9_retention, a1_source_caps, a3_tenant_rows, a5_weighted, a9_safety, e1_set_scores, e4_lexical_f1, e18_repetition, e12_averages, e13_compare, s17_counts)}
