"""Many requests at once: relations of each, and answers stored in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agent_search as A
from ..operators import dictionary as D
from ..operators import facts as T
from ..operators import graph as G
from ..operators import memory as M
from ..operators import planning as P
from ..operators import stored as W
from ..shared import cut
from ..sources.samples import notes, requests
from ..sources.tables import TRIPLES_SQL, table, triples

EXPAND_BY = ("located_in", "belongs_to")


def _named(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def r8_relations_of_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each customer, about the customer and its nation, which many share."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("request"), F.explode(F.array(_named("customer_", "c_custkey"), _named("nation_", "c_nationkey"))).alias("entity"))
    return G.relations_of_requests(triples(spark, sf), c, EXPAND_BY)


def _questions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as questions and answers (their digests: the texts stay where they are read) with their embeddings, which
    share their numbers, as vectors."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("answer"), F.array(F.coalesce("source", F.lit(""))).alias("entities"), F.array(F.coalesce("lang", F.lit(""))).alias("tags"), F.array(F.col("doc_id").cast("string")).alias("citations"), F.floor(F.length(F.coalesce("text", F.lit(""))) / 100).alias("evidence"))
    d = d.withColumn("quality", F.round(M.quality(F.col("answer"), F.col("citations"), F.col("tags"), F.col("evidence"))["score"], 6))
    d = cut(d.withColumn("answer", F.md5("answer")).drop("evidence"))  # a semi-join would be pushed below, onto the texts
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return cut(d.join(v.select("id"), "id", "left_semi")).select("id", F.concat(F.lit("q"), F.col("id").cast("string")).alias("question"), "answer", "entities", "tags", "citations", "quality"), v


def m11_store_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every third is stored already, the others come as one batch."""
    q, v = _questions(spark, sf)
    entries = q.where("id % 3 = 0").withColumn("hits", F.lit(0).cast("long"))
    new = q.where("id % 3 <> 0").withColumnRenamed("id", "new_id")
    s = M.store_batch(entries, new, v, v.withColumnRenamed("id", "new_id"))
    return s.select("id", "question", F.col("answer").alias("answer_md5"), F.array_join("entities", ",").alias("entities"), F.array_join("tags", ",").alias("tags"), F.array_join("citations", ",").alias("citations"), "quality", "hits")


def k4_bucketed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases in buckets: half of the parts stored, the other half upserted in two goes."""
    part = table(spark, sf, "part").select(F.col("p_brand").alias("entity"), F.col("p_name").alias("alias"), F.col("p_type").alias("source"), (F.col("p_size") / 50.0).alias("confidence"), F.col("p_partkey").alias("seq"))
    none = part.where("seq < 0")
    store = W.BucketedTable.create(G.upsert_aliases(none, part.where("seq % 2 = 0")), ("entity", "alias"))
    for turn in (1, 3):
        store.upsert(part.where(f"seq % 4 = {turn}"), G.upsert_aliases)
    return store.read()


def k9_two_stores(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and their vectors in three batches, of which one comes twice; what both stores have of each."""
    d, e = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dim"))
    both = W.TwoStores.create(spark)
    for k in (0, 1, 1, 2):
        both.write(f"b{k}", {"chunks": d.where(F.col("doc_id") % 4 == k), "vectors": e.where(F.col("vec_id") % 4 == k)})
    return both.read("chunks").join(both.read("vectors"), F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "n", "dim")


def c10_dictionary_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' names from a dictionary of all words of five letters and more of the benchmark."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{5,})"), F.lit(1))).alias("alias"))
    return D.mentions(table(spark, sf, "documents"), "doc_id", "text", words, "alias").select("doc_id", F.col("name").alias("alias"), "first")


def f1_f14_agent_run(spark: SparkSession, sf: str) -> DataFrame:
    """Questions to ranked evidence over the notes: both indexes, the relations and the facts that the notes hold, by the
    plan that rules give where no model answers."""
    chunks = notes(spark, sf)
    facts = cut(T.extract_facts(chunks, "doc_id", "text"))
    stated = facts.select(F.col("entity").alias("subject"), F.col("attr").alias("predicate"), F.col("value").alias("object"), "confidence")
    told = T.text_triples(chunks, "doc_id", "text").select("subject", "predicate", "object", F.lit(0.7).alias("confidence"))
    searcher = A.Searcher.over(chunks.select(F.col("doc_id").alias("doc"), "text"), stated.union(told), facts.select("entity"))
    r = requests(spark, sf).withColumn("p", P.fallback_plan(F.col("query")))
    r = r.select("request_id", "query", "p.intent", F.transform(P.entities(F.col("query")), lambda x: x["name"]).alias("entities"), F.col("p.routes").alias("planned"))
    own = {x: F.col(x) for x in ("intent", "next_route", "decision", "steps")} | {x: F.array_join(x, ",") for x in ("entities", "executed", "fallbacks", "errors")}
    own |= {"n_semantic": F.size("semantic"), "best": F.round(F.array_max("semantic"), 6), "n_relations": F.size("relation_texts"), "sql_rows": F.col("sql_rows")}
    return A.run(r, searcher, own).select("request_id", *own)


SPO = "subject, predicate, object"
SQL = {
    "r8_relations_of_requests": f"""WITH {TRIPLES_SQL},
req AS (SELECT c_custkey AS request, 'customer_' || c_custkey AS entity FROM customer UNION SELECT c_custkey, 'nation_' || c_nationkey FROM customer),
spo AS (SELECT {SPO}, max(confidence) AS confidence FROM triples GROUP BY ALL),
ends AS (SELECT subject AS entity, * FROM spo UNION SELECT object, * FROM spo),
d AS (SELECT * FROM (SELECT DISTINCT request, {SPO}, confidence FROM req JOIN ends USING (entity)) QUALIFY row_number() OVER (PARTITION BY request ORDER BY {SPO}) <= 80),
x AS (SELECT * FROM (SELECT request, subject AS entity FROM d WHERE predicate IN ('located_in', 'belongs_to') UNION SELECT request, object FROM d WHERE predicate IN ('located_in', 'belongs_to')) WHERE (request, entity) NOT IN (SELECT (request, entity) FROM req) QUALIFY row_number() OVER (PARTITION BY request ORDER BY entity) <= 5),
f AS (SELECT * FROM (SELECT DISTINCT request, {SPO}, confidence FROM x JOIN ends USING (entity)) QUALIFY row_number() OVER (PARTITION BY request ORDER BY {SPO}) <= 30)
SELECT *, 0 AS hop FROM d UNION ALL SELECT *, 1 FROM f ANTI JOIN d USING (request, {SPO})""",
    "k4_bucketed_upsert": "SELECT p_brand AS entity, p_name AS alias, max_by(p_type, p_partkey) AS source, max(p_size / 50.0::double) AS confidence, max(p_partkey) AS seq FROM part GROUP BY 1, 2",
    "c10_dictionary_mentions": "WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS alias FROM benchmark) SELECT doc_id, alias, (strpos(text, alias) - 1)::int AS first FROM documents JOIN a ON contains(text, alias)",
    "k9_two_stores": "SELECT doc_id, length(text)::int AS n, len(embedding)::int AS dim FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE doc_id % 4 < 3",
    "m11_store_batch": """WITH RECURSIVE q0 AS (SELECT doc_id AS id, coalesce(text, '') AS answer, coalesce(source, '') AS e, coalesce(lang, '') AS t, doc_id::varchar AS c FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
q AS (SELECT *, round(greatest(0, least(1, 0.25::double + CASE WHEN length(regexp_replace(answer, '^\\s+|\\s+$', '', 'g')) >= 80 THEN 0.25::double ELSE -0.2::double END + least(0.15::double, length(answer) // 100 * 0.03::double) + CASE WHEN t IN ('', 'general') THEN 0 ELSE 0.1::double END)), 6) AS quality FROM q0),
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
en AS (SELECT * FROM q WHERE id % 3 = 0),
nw AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM q WHERE id % 3 <> 0 AND quality >= 0.65),
sim AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM v a JOIN v b ON a.id <> b.id AND a.id % 3 <> 0 AND (b.id % 3 = 0 OR b.id < a.id) WHERE list_cosine_similarity(a.v, b.v) >= 0.9199),
pr AS (SELECT sim.* FROM sim JOIN nw ON nw.id = sim.id WHERE s >= 0.92 AND (other % 3 = 0 OR other IN (SELECT id FROM nw))),
st AS (SELECT DISTINCT id FROM pr WHERE other % 3 = 0),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS found UNION ALL SELECT g.k + 1, CASE WHEN nw.id IN (SELECT id FROM st) OR len(list_intersect(found, coalesce((SELECT list(other) FROM pr WHERE pr.id = nw.id), []::BIGINT[]))) > 0 THEN found ELSE list_append(found, nw.id) END FROM g JOIN nw ON nw.k = g.k + 1),
fo AS (SELECT unnest(found) AS id FROM (SELECT found FROM g ORDER BY k DESC LIMIT 1)),
ids AS (SELECT id AS src, id AS to_id FROM en UNION ALL SELECT id, (SELECT max(id) FROM en) + row_number() OVER (ORDER BY id) FROM fo),
tg AS (SELECT pr.id, to_id FROM pr JOIN ids ON src = other WHERE pr.id NOT IN (SELECT id FROM fo) QUALIFY row_number() OVER (PARTITION BY pr.id ORDER BY s DESC, to_id) = 1),
parts AS (SELECT to_id, 0 AS turn, src AS id FROM ids UNION ALL SELECT to_id, 1, id FROM tg),
p AS (SELECT to_id, turn, q.* FROM parts JOIN q USING (id)),
best AS (SELECT to_id, arg_max(id, (quality, -id)) AS b, count(*) AS k FROM p WHERE turn = 1 GROUP BY 1),
lists AS (SELECT to_id, 'e' AS f, e AS x, min((turn, id)) AS o FROM p WHERE e <> '' GROUP BY ALL UNION ALL SELECT to_id, 't', t, min((turn, id)) FROM p WHERE t <> '' GROUP BY ALL UNION ALL SELECT to_id, 'c', c, min((turn, id)) FROM p GROUP BY ALL),
agg AS (SELECT to_id, f, list(x ORDER BY o) AS l FROM lists GROUP BY ALL)
SELECT i.to_id::BIGINT AS id, 'q' || w.id AS question, md5(w.answer) AS answer_md5, coalesce((SELECT array_to_string(l, ',') FROM agg WHERE agg.to_id = i.to_id AND f = 'e'), '') AS entities, coalesce((SELECT array_to_string(l, ',') FROM agg WHERE agg.to_id = i.to_id AND f = 't'), '') AS tags, (SELECT array_to_string(l[1:20], ',') FROM agg WHERE agg.to_id = i.to_id AND f = 'c') AS citations, w.quality, coalesce(k, 0)::BIGINT AS hits
FROM ids i JOIN q o ON o.id = i.src LEFT JOIN best USING (to_id) LEFT JOIN q n ON n.id = b JOIN q w ON w.id = CASE WHEN n.quality >= o.quality THEN n.id ELSE o.id END""",
}
QUERIES = {f.__name__: f for f in (r8_relations_of_requests, m11_store_batch, k4_bucketed_upsert, k9_two_stores, c10_dictionary_mentions, f1_f14_agent_run)}
