"""What a run of the router leaves out: steps after the end, and an index of vectors that few queries don't need."""

from pyspark.sql import functions as F

from quillspark.operators import agent_search, retrieval, routing, vector_index


def test_a_run_ends_with_its_last_row(spark):
    r = spark.createDataFrame([(1, "general", "a", ["x"], ["semantic"])], "request_id long, intent string, query string, entities array<string>, planned array<string>")
    served = []

    def retrieve(states):
        served.append(1)
        return states.withColumn("semantic", F.array_repeat(F.lit(0.9), 15))

    short = routing.run(r, retrieve, lambda s: s.checkpoint()).collect()
    assert len(served) <= 2 < routing.MAX_STEPS
    assert short == routing.run(r, retrieve).collect()


def test_few_queries_need_no_index_of_vectors(spark, monkeypatch):
    texts = [(i, f"w{'abc'[i % 3]} x{'defgh'[i % 5]} 番茄" + " y" * (i % 4)) for i in range(60)] + [(70, ""), (71, None)]
    chunks = spark.createDataFrame(texts, "doc long, text string")
    none = spark.createDataFrame([], "subject string, predicate string, object string, confidence double")
    queries = agent_search.dense_vectors(chunks.where("doc % 9 = 0").withColumnRenamed("doc", "query"), "query", "text")
    build = vector_index.build

    def no(*a, **kw):
        raise AssertionError("an index")

    monkeypatch.setattr(vector_index, "build", no)
    searcher = agent_search.Searcher.over(chunks, none, spark.createDataFrame([], "entity string"), cells=3)
    few = searcher.near(queries).collect()
    monkeypatch.setattr(vector_index, "build", build)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 2)
    assert sorted(map(tuple, few)) == sorted(map(tuple, searcher.near(queries).collect())) and len(few) == 7 * 30
    want = {r.doc: {x.idx: x.value for x in r.v} for r in chunks.select("doc", retrieval.hashed_vector(F.col("text"), 384).alias("v")).collect() if r.v}
    got = {r.key: {i: x for i, x in enumerate(r.v) if x} for r in agent_search._vectors(searcher.sums).collect()}
    assert got == want
