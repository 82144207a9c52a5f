"""Searches of many queries over stored indexes: every row whose id 50 divides, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import sparse_index as S
from ..operators import vector_index as V
from ..sources.tables import table
from .retrieval import BM25

K, EVERY = 15, 50


def _vectors(spark: SparkSession, sf: str, metric: str, k: int, **kw) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return V.search(V.build(e, "vec_id", "embedding", metric), e.where(F.col("vec_id") % EVERY == 0), "vec_id", "embedding", k, **kw)


def _sparse_index(spark: SparkSession, sf: str) -> S.SparseIndex:
    """All documents, added in two segments."""
    docs, index = table(spark, sf, "documents"), S.create(spark)
    S.add(index, docs.where("doc_id % 2 = 0"), "doc_id", "text")
    S.add(index, docs.where("doc_id % 2 <> 0"), "doc_id", "text")
    return index


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("doc_id") % EVERY == 0)


def v7_vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """The exact way: cells that the triangle inequality rules out are left."""
    return _vectors(spark, sf, "l2", K, exact=True).select("query", F.col("key").alias("vec_id"), F.col("value").alias("distance"), "rank")


def v7_vector_index_probed(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest cells alone: some rows of the exact result may be missing."""
    return _vectors(spark, sf, "l2", K).select("query", F.col("key").alias("vec_id"), F.col("value").alias("distance"), "rank")


def v14_similar_index(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf, "cosine", K, exact=True, least=0.3).select("query", F.col("key").alias("vec_id"), F.col("value").alias("similarity"), "rank")


def v8_sparse_index(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(_sparse_index(spark, sf), _asked(spark, sf), "doc_id", "text", K)


def v5_updated_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index after every seventh document was removed."""
    index = _sparse_index(spark, sf)
    S.remove(index, table(spark, sf, "documents").where("doc_id % 7 = 0"), "doc_id")
    return S.search(index, _asked(spark, sf), "doc_id", "text", K)


def v9_hybrid_index(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and embeddings share their numbers: both sides of a query are those of its number."""
    dense = _vectors(spark, sf, "l2", 2 * K, exact=True).select("query", F.col("key").alias("doc"), F.col("value").alias("distance"))
    sparse = S.search(_sparse_index(spark, sf), _asked(spark, sf), "doc_id", "text", 2 * K)
    return R.hybrid_all(dense, sparse, K)


def _near(metric: str) -> str:
    v = "CAST(embedding AS DOUBLE[])"
    value = "sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))" if metric == "l2" else "list_sum(list_transform(list_zip(q.v, e.v), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(q.v, lambda x: x * x)) * list_sum(list_transform(e.v, lambda x: x * x)))"
    return f"ev AS (SELECT vec_id, {v} AS v FROM embeddings WHERE embedding IS NOT NULL), near AS (SELECT q.vec_id AS query, e.vec_id, round({value}, 6) AS value FROM ev q JOIN ev e ON q.vec_id % {EVERY} = 0)"


def _sparse_sql(tokens_of: str = "documents") -> str:
    """CTE sparse(query, doc, score): the plain sum over all postings of the documents that bm is made from."""
    plain = BM25.replace("FROM documents", f"FROM {tokens_of}")
    return f"""{plain},
qtok AS (SELECT doc_id AS query, lower(unnest(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+'))) AS token FROM documents WHERE doc_id % {EVERY} = 0),
qcj AS (SELECT doc_id AS query, regexp_extract_all(coalesce(text, ''), '[\\x{{4e00}}-\\x{{9fff}}]') AS c FROM documents WHERE doc_id % {EVERY} = 0),
qall AS (SELECT * FROM qtok UNION ALL SELECT query, unnest(c) FROM qcj UNION ALL SELECT query, c[i] || c[i + 1] FROM (SELECT query, c, unnest(range(1, greatest(len(c), 1))) AS i FROM qcj)),
qn AS (SELECT query, token, count(*) AS k FROM qall GROUP BY ALL),
qt AS (SELECT query, token, k / max(k) OVER (PARTITION BY query)::double AS share FROM qn),
sparse AS (SELECT query, doc_id AS doc, round(sum(weight * share), 6) AS score FROM qt JOIN bm USING (token) GROUP BY ALL HAVING score > 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY score DESC, doc))::int AS rank FROM sparse)"""


SQL = {
    "v7_vector_index": f"WITH {_near('l2')}, r AS (SELECT query, vec_id, value AS distance, (row_number() OVER (PARTITION BY query ORDER BY value, vec_id))::int AS rank FROM near) SELECT * FROM r WHERE rank <= {K}",
    "v14_similar_index": f"WITH {_near('cosine')}, r AS (SELECT query, vec_id, value AS similarity, (row_number() OVER (PARTITION BY query ORDER BY value DESC, vec_id))::int AS rank FROM near) SELECT * FROM r WHERE rank <= {K} AND similarity >= 0.3",
    "v8_sparse_index": f"WITH {_sparse_sql()} SELECT query, doc, score, rank FROM ranked WHERE rank <= {K}",
    "v5_updated_index": f"WITH {_sparse_sql('(SELECT * FROM documents WHERE doc_id % 7 <> 0)')} SELECT query, doc, score, rank FROM ranked WHERE rank <= {K}",
    "v9_hybrid_index": f"""WITH {_sparse_sql()}, {_near('l2')},
d AS (SELECT query, vec_id AS doc, 0.7::double / (1 + value) AS s FROM near QUALIFY row_number() OVER (PARTITION BY query ORDER BY value, vec_id) <= {2 * K}),
p AS (SELECT query, doc, 0.3::double * score / max(score) OVER (PARTITION BY query) AS s FROM ranked WHERE rank <= {2 * K}),
f AS (SELECT query, doc, round(sum(s), 6) AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM p) GROUP BY ALL)
SELECT query, doc, score, (row_number() OVER w)::int AS rank FROM f WINDOW w AS (PARTITION BY query ORDER BY score DESC, doc) QUALIFY row_number() OVER w <= {K}""",
}
QUERIES = {f.__name__: f for f in (v7_vector_index, v7_vector_index_probed, v14_similar_index, v8_sparse_index, v5_updated_index, v9_hybrid_index)}
