"""Readers, writers and streams over files of their own."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.sources import readers
from factloom.streaming import events as E


def test_triples_and_tolerance(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text(json.dumps({"doc_id": "d", "head": "a", "tail": "b", "other": 1}) + "\n\n" + json.dumps({"doc_id": "e", "confidence": 0.5}) + "\n")
    rows = readers.triples(spark, str(path)).orderBy("seq").collect()
    assert [(r.doc_id, r["head"], r.confidence) for r in rows] == [("d", "a", 0.0), ("e", "", 0.5)] and "other" not in rows[0]
    path.write_text('{"doc_id": "d"}\nnot json\n')
    assert readers.jsonl(spark, str(path), readers.CHUNK, tolerant=True).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(path), readers.CHUNK).collect()
    assert readers.jsonl_or_empty(spark, str(tmp_path / "none.jsonl"), readers.CHUNK).count() == 0


def test_question_readers(spark, tmp_path):
    (tmp_path / "q.csv").write_text('question,option 1,option 2,answer\n"a, b?",x,y,2\n')
    (tmp_path / "q.tsv").write_text("index\tquestion\tanswer\timage\n7\tq?\ta\tzzz\n")
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "1", "question": "q", "options": {"A": "x", "B": "y"}, "label": "B", "images": ["i"]}) + "\n")
    (tmp_path / "q.json").write_text(json.dumps([{"qid": 1, "question": "q", "answer": "a", "q_lang": "en"}, {"qid": 2, "question": "r", "answer": "a", "q_lang": "zh"}, {"qid": 3, "question": "s", "answer": "a"}]))
    spark.createDataFrame([("q1", "a1", "big"), ("q2", None, "big")], "question string, answer string, image string").write.parquet(str(tmp_path / "q.parquet"))
    read = lambda kind, name: readers.read(spark, kind, str(tmp_path / name), "set").orderBy("question").collect()
    assert [(r.question, r.answer) for r in read("choice_csv", "q.csv")] == [("a, b?", "y")]
    assert [(r.question_id, r.answer) for r in read("choice_tsv", "q.tsv")] == [("7", "a")]
    assert [(r.question_id, r.answer) for r in read("options_jsonl", "q.jsonl")] == [("1", "y")]
    assert [r.question for r in read("language_json", "q.json")] == ["q", "s"]
    assert [(r.question, r.answer) for r in read("parquet", "q.parquet")] == [("q1", "a1"), ("q2", "")]
    with pytest.raises(ValueError, match="unknown reader"):
        readers.read(spark, "odd", "", "set")


def test_graphml_round(spark, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text('<graphml><graph><node id="a"><data key="d0">Gene</data></node><node id="b"/><edge source="a" target="b"><data key="d1">0.5</data></edge></graph></graphml>')
    nodes, edges = readers.graphml(spark, str(path))
    assert {r.id: dict(r.data) for r in nodes.collect()} == {"a": {"d0": "Gene"}, "b": {}}
    assert [(r["head"], r["tail"], dict(r.data)) for r in edges.collect()] == [("a", "b", {"d1": "0.5"})]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("x", None), ("y", "b")], "k string, v string")
    readers.write_csv(df, str(tmp_path / "c"), ["k", "v", "w"])
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {("x", None, None), ("y", "b", None)}
    assert sorted(r.sample_id for r in readers.append_numbered(df, "k", 41).collect()) == ["qg_000042", "qg_000043"]


@pytest.fixture
def log(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i % 50:02d}", i % 3, "click", 1.0, "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(2).write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def test_stream_restarts_where_it_stopped(spark, log, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        E.appended(E.once(E.event_stream(spark, log)), out, mark)
        assert spark.read.parquet(out).count() == 60
    spark.read.parquet(log).limit(5).withColumn("event_id", F.col("event_id") + 100).write.mode("append").parquet(log)
    E.appended(E.once(E.event_stream(spark, log)), out, mark)
    assert spark.read.parquet(out).count() == 65


def test_windows_of_a_stream(spark, log):
    query = E.sliding_rates(E.event_stream(spark, log), "10 seconds", "10 seconds").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == 60
    query = E.stalled_sessions(E.event_stream(spark, log), "5 seconds").writeStream.format("memory").queryName("stalls").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("stalls").agg(F.sum("n_events")).first()[0] == 60
