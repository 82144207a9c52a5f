import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evidence, graph, guarded_sql, memory, retrieval, text
from quillspark.sources import records


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_tokens(spark):
    assert one(spark, retrieval.tokens, "Ab 蛋白质 c1") == ["ab", "c", "蛋白", "白质", "蛋", "白", "质"]
    assert one(spark, retrieval.tokens, None) == [] and one(spark, retrieval.tokens, "蛋") == ["蛋"]
    assert one(spark, retrieval.token_id, "protein") == 91873


def test_cosine_of_zero_vector(spark):
    assert one(spark, lambda c: retrieval.cosine(c, [1.0, 0.0]), [0.0, 0.0], "array<float>") is None


def test_cleaning(spark):
    assert one(spark, text.squeeze, "\n a  b\n\n\n\nc ") == "a b\n\nc" and one(spark, text.squeeze, " \n") is None
    assert one(spark, text.is_advert, "关注我们") and not one(spark, text.is_advert, "关注" + "a" * 100)
    assert one(spark, text.is_header_footer, " 第 3 页 ") and one(spark, text.is_header_footer, "page 9 of 10") and not one(spark, text.is_header_footer, "see page 9")
    assert one(spark, text.degarble, "a$b$cdefgh") == "abcdefgh" and one(spark, text.degarble, "a$$") == ""


def test_canonical_id(spark):
    assert one(spark, graph.canonical_id, " Crème  Brûlée! ") == "crème_brûlée" and one(spark, graph.canonical_id, "?") == "unknown"
    assert one(spark, lambda c: graph.canonical_id(c, "food"), "") == "food_" and one(spark, lambda c: graph.canonical_id(c, "food"), "food egg") == "food_egg"


def test_citations(spark):
    assert one(spark, evidence.citations, "a[来源2] b[证据1] c[来源2]") == [2, 1]


def test_rewrites(spark):
    rows, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, graph.insert_absent(rows, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert [tuple(r) for r in graph.delete_keys(rows, new, ["k"]).collect()] == [(1, "a")]


def test_rank_fusion(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2)], "k int, rank int"), spark.createDataFrame([(2, 1)], "k int, rank int")
    assert [r.k for r in retrieval.rank_fusion([a, b], "k", 5).collect()] == [2, 1]


def test_tail_keeps_the_last_line(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "b" * 500)], "s int, n int, x string")
    assert [r.n for r in memory.tail_within(t, "s", ["n"], "x", 10).collect()] == [2]


def test_guarded_sql(spark):
    assert guarded_sql.sanitise("```sql\nSELECT 1;\n```") == "SELECT 1"
    for bad in ("drop table x", "select 1; select 2", "select 1 -- x", "select * from (delete from x)".replace("(", "( ")):
        with pytest.raises(guarded_sql.RefusedSql):
            guarded_sql.sanitise(bad)
    assert guarded_sql.fuzzy("select * from t where a = '5%'") == "select * from t where a ILIKE '%5\\\\%%'"
    spark.createDataFrame([("50%",), ("5x",)], "a string").createOrReplaceTempView("t")
    assert [r.a for r in guarded_sql.run(spark, guarded_sql.fuzzy("select a from t where a in ('0%')")).collect()] == ["50%"]
    with pytest.raises(Exception) as e:
        guarded_sql.run(spark, "select nothing from t").collect()
    assert guarded_sql.error_kind(e.value) == "schema_mismatch"


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"foods": [{"n": 1}, {"n": 2}]}))
    (tmp_path / "b.jsonl").write_text('{"n": 1}\n\n[1]\n{"n": 2}\n')
    (tmp_path / "c.csv").write_bytes("﻿n,m\n1,x\n2,y\n".encode())
    for name, want in (("a.json", [1, 2]), ("b.jsonl", [1, 2]), ("c.csv", ["1", "2"])):
        assert sorted(r.n for r in records.read_records(spark, str(tmp_path / name)).collect()) == want
    with pytest.raises(ValueError):
        records.read_records(spark, "x.xml")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.MD").write_bytes(b"# a \xff")
    assert [(r.suffix, r.route) for r in records.read_directory(spark, str(tmp_path / "d")).collect()] == [(".md", "text")]
    assert records.append(spark.range(2), str(tmp_path / "out")) and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_missing_vector_raises(spark):
    chunks, vectors = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, text string"), spark.createDataFrame([(1, [0.5])], "chunk_id long, v array<double>")
    with pytest.raises(Exception, match="no vector for chunk 2"):
        records.with_embeddings(chunks, vectors).collect()


def test_newest_turn_stays_whole(spark):
    long = "a" * 1_200_000
    t = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "user", long)], "s int, turn int, role string, text string")
    assert memory.context(t, "s", ["turn"], "role", "text").first().context == f"user: {long}"
