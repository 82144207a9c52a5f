"""Queries of retrieval and text over the test tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import text as X
from ..sources.tables import table

# the example inputs that these queries search for
PHRASE, VECTOR_ID, K = "the of and thation", 0, 15
RULES = {"english": [" the ", " of ", " and "], "german": [" die ", " und ", " der "], "french": [" de ", " la ", " par "], "spanish": [" el ", " los ", " que "]}


def _phrase(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, PHRASE)], "query_id long, text string")


def _vector(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where(F.col("vec_id") == VECTOR_ID).select("embedding").first()[0]]


def v2_hashed_dense(spark: SparkSession, sf: str) -> DataFrame:
    return R.hashed_dense(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "idx", F.round("value", 6).alias("value"))


def v4_bm25_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", R.token_id(F.col("token")).alias("token_id"), "token", F.round("weight", 6).alias("weight"))


def v7_dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.dense_topk(table(spark, sf, "embeddings"), "vec_id", "embedding", _vector(spark, sf), K)


def _sparse(spark: SparkSession, sf: str, k: int) -> DataFrame:
    terms = R.query_terms(_phrase(spark), "query_id", "text")
    return R.sparse_topk(R.bm25(table(spark, sf, "documents"), "doc_id", "text", terms=terms), terms, "doc_id", "query_id", k)


def v8_sparse_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _sparse(spark, sf, K).select("doc_id", "score", "rank")


def v9_hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    dense = R.dense_topk(table(spark, sf, "embeddings"), "vec_id", "embedding", _vector(spark, sf), 2 * K).withColumnRenamed("vec_id", "doc_id")
    return R.hybrid(dense, _sparse(spark, sf, 2 * K), "doc_id", K)


def v11_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return R.query_terms(table(spark, sf, "benchmark"), "item_id", "text").select("item_id", "token", F.round("share", 6).alias("share"))


def v14_similar(spark: SparkSession, sf: str) -> DataFrame:
    return R.similar(table(spark, sf, "embeddings"), "vec_id", "embedding", _vector(spark, sf), K, 0.3)


def v15_text_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return R.text_fallback(table(spark, sf, "documents"), "doc_id", "text", "of the", "n_chars", K)


def p1_line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return X.line_blocks(table(spark, sf, "documents"), "doc_id", "text")


def p7_degarble(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.degarble(F.col("text"))).alias("clean_md5"))


def p5_p6_p11_drop_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = X.line_blocks(table(spark, sf, "documents"), "doc_id", "text")
    c = F.col("content")
    return b.where(~X.is_advert(c) & ~X.is_header_footer(c) & X.meaningful(c)).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).cast("long").alias("chars"))


def p8_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("clean_md5"))


def c1_c5_classify(spark: SparkSession, sf: str) -> DataFrame:
    return X.classify(table(spark, sf, "documents"), "doc_id", "text", RULES)


def h2_retrieval_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = X.line_blocks(table(spark, sf, "documents"), "doc_id", "text")
    return X.retrieval_chunks(chunks, "doc_id", "content").select("doc_id", "block", "token_count", "kept_short")


TOKENS = """
tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+'))) AS token FROM documents),
cj AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\x{4e00}-\\x{9fff}]') AS c FROM documents),
alltok AS (SELECT * FROM tok UNION ALL SELECT doc_id, unnest(c) FROM cj UNION ALL SELECT doc_id, c[i] || c[i + 1] FROM (SELECT doc_id, c, unnest(range(1, greatest(len(c), 1))) AS i FROM cj))"""
BM25 = (
    TOKENS
    + """,
tf AS (SELECT doc_id, token, count(*) AS tf FROM alltok GROUP BY ALL),
dl AS (SELECT d.doc_id, coalesce(x.n, 0) AS dl FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM alltok GROUP BY 1) x ON d.doc_id = x.doc_id),
c AS (SELECT count(*) AS n, greatest(avg(dl), 1.0) AS a FROM dl),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT tf.doc_id, token, ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / a)) AS weight FROM tf JOIN df USING (token) JOIN dl ON tf.doc_id = dl.doc_id, c)"""
)
TERMS = f"""qt AS (SELECT token, count(*) AS tf FROM (SELECT unnest(regexp_extract_all('{PHRASE}', '[a-zA-Z]+')) AS token) GROUP BY 1),
terms AS (SELECT token, tf / (SELECT max(tf) FROM qt)::double AS share FROM qt),
sparse AS (SELECT doc_id, round(sum(weight * share), 6) AS score FROM bm JOIN terms USING (token) GROUP BY 1 HAVING score > 0)"""
DENSE = f"dense AS (SELECT e.vec_id, round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID}) q WHERE e.embedding IS NOT NULL)"
def lines_sql(table: str = "documents") -> str:
    """CTE blocks(doc_id, block, kind, n_lines, content) of the texts of table."""
    return rf"""
ln AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {table})),
k AS (SELECT *, CASE WHEN regexp_full_match(line, '\|.+\|') THEN 'table' WHEN regexp_full_match(line, '#{{1,6}}\s+.+') THEN 'heading' WHEN regexp_full_match(line, '\s*[-*+]\s+.+') THEN 'list' WHEN regexp_full_match(line, '\s*') THEN 'blank' ELSE 'text' END AS kind FROM ln),
p AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM k),
b AS (SELECT *, sum(CASE WHEN kind <> 'heading' AND coalesce(kind = prev OR (kind = 'text' AND prev = 'heading'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM p),
g AS (SELECT doc_id, run, CASE min_by(kind, pos) WHEN 'heading' THEN 'text' ELSE min_by(kind, pos) END AS kind, count(*) AS n_lines, string_agg(CASE WHEN kind = 'list' THEN '- ' || regexp_replace(regexp_replace(line, '^\s*[-*+]\s+', ''), '\s+$', '') ELSE line END, chr(10) ORDER BY pos) AS content FROM b WHERE kind <> 'blank' GROUP BY doc_id, run),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS block, kind, n_lines, CASE kind WHEN 'text' THEN regexp_replace(content, '^\s+|\s+$', '', 'g') ELSE content END AS content FROM g WHERE kind <> 'table' OR n_lines > 1)"""


LINES = lines_sql()


def _count(term: str) -> str:
    return f"(length(t) - length(replace(t, '{term}', ''))) // {len(term)}"


SCORES = ", ".join(f"({' + '.join(map(_count, terms))})::bigint AS {name}" for name, terms in RULES.items())
BEST = f"greatest({', '.join(RULES)})"
TOTAL = " + ".join(RULES)

SQL = {
    "v2_hashed_dense": f"WITH {TOKENS}, s AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::bigint % 384 AS idx, sum(CASE WHEN ('0x' || substr(md5(token), 9, 2))::bigint % 2 = 0 THEN 1 ELSE -1 END) AS s FROM alltok GROUP BY ALL HAVING s <> 0) SELECT doc_id, idx, round(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)::double), 6) AS value FROM s",
    "v4_bm25_sparse": f"WITH {BM25} SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::bigint % 100000 AS token_id, token, round(weight, 6) AS weight FROM bm WHERE weight > 0",
    "v7_dense_topk": f"WITH {DENSE} SELECT vec_id, distance FROM dense ORDER BY distance, vec_id LIMIT {K}",
    "v8_sparse_topk": f"WITH {BM25}, {TERMS} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::int AS rank FROM sparse ORDER BY rank LIMIT {K}",
    "v9_hybrid_fusion": f"WITH {BM25}, {TERMS}, {DENSE}, d AS (SELECT vec_id AS doc_id, distance FROM dense ORDER BY distance, vec_id LIMIT {2 * K}), s AS (SELECT doc_id, score FROM sparse ORDER BY score DESC, doc_id LIMIT {2 * K}) SELECT doc_id, round(0.7::double * coalesce(1 / (1 + distance), 0) + 0.3::double * coalesce(score / (SELECT max(score) FROM s), 0), 6) AS score FROM d FULL JOIN s USING (doc_id) ORDER BY score DESC, doc_id LIMIT {K}",
    "v11_query_terms": "WITH t AS (SELECT item_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+'))) AS token FROM benchmark), c AS (SELECT item_id, token, count(*) AS n FROM t GROUP BY ALL) SELECT item_id, token, round(n / max(n) OVER (PARTITION BY item_id)::double, 6) AS share FROM c",
    "v14_similar": f"WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = {VECTOR_ID}), s AS (SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, v), lambda x: x[1]::double * x[2]::double)) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) * list_sum(list_transform(v, lambda x: x::double * x::double))), 6) AS similarity FROM embeddings, q) SELECT * FROM s WHERE similarity >= 0.3 ORDER BY similarity DESC, vec_id LIMIT {K}",
    "v15_text_fallback": f"SELECT doc_id, n_chars, 0.5::double AS score FROM documents WHERE contains(text, 'of the') ORDER BY n_chars DESC, doc_id LIMIT {K}",
    "p1_line_blocks": f"WITH {LINES} SELECT * FROM blocks",
    "p5_p6_p11_drop_blocks": f"WITH {LINES}, t AS (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS s FROM blocks) SELECT doc_id, count(*) AS blocks, sum(length(content))::bigint AS chars FROM t WHERE NOT (length(content) < 100 AND regexp_matches(content, '{'|'.join(f'(?:{p})' for p in X.ADVERTS)}')) AND NOT (length(s) <= 50 AND regexp_matches(s, '{'|'.join(f'(?:{p})' for p in X.HEADERS_FOOTERS)}')) AND length(content) >= 3 GROUP BY doc_id",
    "p7_degarble": "WITH c AS (SELECT doc_id, text, regexp_replace(text, '[^" + X.VALID[1:].replace("'", "''") + "', '', 'g') AS clean FROM documents) SELECT doc_id, md5(CASE WHEN (length(text) - length(clean)) / length(text)::double > 0.3 THEN '' ELSE clean END) AS clean_md5 FROM c",
    "p8_squeeze": r"SELECT doc_id, md5(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^[ \t\n\r]+', ''), '[ \t\n\r]+$', ''), '')) AS clean_md5 FROM documents",
    "c1_c5_classify": f"WITH s AS (SELECT doc_id, {SCORES} FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)), r AS (SELECT *, {BEST} AS score, round(coalesce({BEST} / nullif({TOTAL}, 0)::double, 0), 4) AS confidence FROM s) SELECT doc_id, CASE WHEN confidence < 0.3 THEN 'unknown' {' '.join(f'''WHEN {n} = score THEN '{n}' ''' for n in RULES)} END AS category, score, confidence FROM r",
    "h2_retrieval_chunks": f"WITH {LINES}, t AS (SELECT doc_id, block, floor(length(content) * 0.7::double)::int AS token_count FROM blocks), m AS (SELECT *, max(token_count) OVER (PARTITION BY doc_id) < 50 AS kept_short FROM t) SELECT * FROM m WHERE token_count >= 50 OR kept_short",
}
QUERIES = {f.__name__: f for f in (v2_hashed_dense, v4_bm25_sparse, v7_dense_topk, v8_sparse_topk, v9_hybrid_fusion, v11_query_terms, v14_similar, v15_text_fallback, p1_line_blocks, p5_p6_p11_drop_blocks, p7_degarble, p8_squeeze, c1_c5_classify, h2_retrieval_chunks)}
