import json
import os

from pyspark.sql import functions as F

from quillspark.functions import sql
from quillspark.operators import blocks, evidence, graph, retrieval, text
from quillspark.streaming import flows


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def arrive(folder, *files):
    """Files of JSON lines, each a second later than the one before."""
    for i, rows in enumerate(files):
        path = folder / f"{i}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def test_functions_equal_the_operators(spark):
    assert sql.register(spark) == list(sql.FUNCTIONS)
    d = spark.createDataFrame([(" Crème  Brûlée! \n\n\n\nx [来源2] [证据1][来源2]",), ("",), (None,), ("protein",)], "t string")
    d.createOrReplaceTempView("sql_texts")
    got = spark.sql("select qs_token_count(t) a, qs_squeeze(t) b, qs_canonical_id(t) c, qs_token_id(t) d, qs_occurrences(t, 'r') e, qs_citations(t) f from sql_texts")
    t = F.col("t")
    want = d.select(text.token_count(t), text.squeeze(t), graph.canonical_id(t), retrieval.token_id(t), text.occurrences(t, "r"), evidence.citations(t))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_blocks_of_a_stream(spark, tmp_path):
    docs = [{"doc_id": i, "text": f"# T{i}\nbody\n\n- a\n- b"} for i in range(5)]
    arrive(tmp_path, docs[:3], docs[3:])
    got = run(flows.block_stream(flows.texts(spark, str(tmp_path), files=1)), "stream_blocks", "append")
    want = blocks.line_blocks(spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string"), "doc_id", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_logs_are_left_out(spark, tmp_path):
    first = [{"at": "2024-01-01T00:01:00Z", "intent": "a", "ms": 10}, {"at": "2024-01-01T00:02:00Z", "intent": "a", "ms": 30}, {"at": "2024-01-01T01:00:00Z", "intent": "a", "ms": 5}]
    late = [{"at": "2024-01-01T00:03:00Z", "intent": "a", "ms": 99}, {"at": "2024-01-01T02:00:00Z", "intent": "a", "ms": 1}]
    # rows are late by the watermark that the batch before the last one left
    arrive(tmp_path, first, [{"at": "2024-01-01T01:10:00Z", "intent": "a", "ms": 7}], late, [{"at": "2024-01-01T03:00:00Z", "intent": "b", "ms": 1}], [{"at": "2024-01-01T04:00:00Z", "intent": "b", "ms": 1}])
    logs = flows.texts(spark, str(tmp_path), "at timestamp, intent string, ms long", 1)
    got = run(flows.log_figures(logs, "at", ["intent"], "ms"), "stream_figures", "append").collect()
    by_hour = {r.window.start.hour * 60 + r.window.start.minute: (r.requests, r.mean_latency, r.max_latency) for r in got}
    assert by_hour[0] == (2, 20.0, 30) and by_hour[60] == (1, 5.0, 5)


def test_upserts_can_come_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    arrive(tmp_path / "in", [{"id": i, "seq": i, "query": f"q{i}", "status": "new"} for i in range(3)], [{"id": 1, "seq": 9, "query": "other", "status": "done"}])
    schema, held = "id long, seq long, query string, status string", {"rows": []}

    def write(df):
        held["rows"] = [tuple(r) for r in df.select("id", "seq", "query", "status").collect()]

    logs = flows.texts(spark, str(tmp_path / "in"), schema, 1)
    for k in range(2):  # all files come again with a new checkpoint
        q = flows.upsert_batches(logs, lambda: spark.createDataFrame(held["rows"], schema), write, str(tmp_path / f"c{k}"), ["id"], ["seq"], ["query"], ["status", "seq"])
        q.awaitTermination(120)
        assert sorted(held["rows"]) == [(0, 0, "q0", "new"), (1, 9, "q1", "done"), (2, 2, "q2", "new")]


def test_hot_turns_of_sessions(spark, tmp_path):
    arrive(tmp_path, *([{"session": s, "turn": 2 * i + k, "role": "user", "text": f"{s}{2 * i + k}"} for s in "ab" for k in range(2)] for i in range(3)))
    turns = flows.texts(spark, str(tmp_path), "session string, turn long, role string, text string", 1)
    got = run(flows.hot_turns(turns, most=3), "stream_hot", "update")
    last = {r.turn for r in got.where("session = 'a'").collect() if r.place == 3}
    assert 5 in last and got.where("turn = 5 and session = 'b'").first().text == "b5" and got.agg(F.max("place")).first()[0] == 3
