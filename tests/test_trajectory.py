"""Trajectories and articles."""

from pyspark.sql import functions as F

from factloom.operators import judging, trajectory
from factloom.sources import articles


def test_steps(spark):
    m = [("assistant", "text", " a  b ", None), ("user", "text", "q", None), ("assistant", "call", "", [("search", "x" * 9), ("fetch", None)]), ("assistant", "tool_result", "big", None), ("assistant", "text", " ", None)]
    df = spark.createDataFrame([("s", m), ("t", None)], f"k string, messages array<{trajectory.MESSAGE}>")
    assert [(r.k, r.idx, r.step) for r in trajectory.steps(df, "k", "messages", limit=4).orderBy("idx").collect()] == [("s", 0, "a b"), ("s", 2, "search(xxxx)\nfetch()")]


def test_sessions(spark):
    kind = "map<string,struct<messages:array<struct<timestamp:int,type:string,sender:string,content:string>>>>"
    history = {"1": ([(5, "response", "m", "b"), (2, None, "user", "a")],), "0": ([(1, None, "x", "old")],)}
    df = spark.createDataFrame([("s", 1, history), ("t", 9, history)], f"k string, current_session int, history {kind}")
    got = trajectory.session_turns(df, "k", "history").withColumn("role", trajectory.role(F.col("sender"), F.col("type"))).orderBy("place").collect()
    assert [(r.k, r.content, r.role) for r in got] == [("s", "a", "user"), ("s", "b", "assistant")]
    assert trajectory.session_turns(df, "k", "history", "0").count() == 2


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<article><article-title>A <i>b</i></article-title><abstract><p>x</p></abstract><body><sec><title>Intro</title><p>one <b>two</b></p></sec><sec><p> </p></sec><sec><p>three</p></sec></body></article>")
    (tmp_path / "b.xml").write_text("<article><body><p>bare</p></body></article>")
    (tmp_path / "c.xml").write_text("no xml")
    got = {r["name"]: r for r in articles.articles(spark, str(tmp_path)).collect()}
    assert got["a.xml"].title == "A b" and got["a.xml"].abstract == "x" and [tuple(s) for s in got["a.xml"].sections] == [("Intro", "one two"), ("Body", "three")]
    assert [tuple(s) for s in got["b.xml"].sections] == [("Body", "bare")] and got["c.xml"].title is None
    chunks = articles.chunk_sections(articles.articles(spark, str(tmp_path)), "name").collect()
    assert {(r.chunk_id, r.text) for r in chunks} == {("a.xml::chunk_00_0000", "one two"), ("a.xml::chunk_01_0000", "three"), ("b.xml::chunk_00_0000", "bare")}


def test_judgments_by_place(spark):
    claims = spark.createDataFrame([(1, "C", "x"), (1, "c ", "y"), (2, "d", "z")], "s int, c string, t string")
    b = judging.buckets(claims, "s", "c", "t")
    assert {(r.s, r.concept, tuple(r.claims)) for r in b.collect()} == {(1, "c", ("x", "y")), (2, "d", ("z",))}
    out = spark.createDataFrame([(1, "c", [" Refuted"])], "s int, concept string, verdicts array<string>")
    assert {(r.claim, r.verdict, r.score) for r in judging.judged(b, out, ["s", "concept"]).collect()} == {("x", "refuted", 1.0), ("y", "unverifiable", 0.5), ("z", "unverifiable", 0.5)}
    fixed = judging.repaired(spark.createDataFrame([(1,), (2,), (3,)], "claim_id int"), spark.createDataFrame([(1, "refuted"), (2, "supported")], "claim_id int, verdict string"))
    assert {r.claim_id: r.action for r in fixed.collect()} == {1: "repair", 2: "keep", 3: "check"}


def test_scored_choices(spark):
    s = spark.createDataFrame([(1, ["x", "y"], 0), (2, ["x", "y"], 1), (3, ["x"], -1)], "k int, options array<string>, expected int")
    a = spark.createDataFrame([(1, "A"), (3, "x")], "k int, answer string")
    got = {r.k: (r.picked, r.error, r.score) for r in judging.scored_choices(s, a, "k").collect()}
    assert got == {1: (0, "", 1.0), 2: (-1, "missing_answer", 0.0), 3: (0, "no_correct_option", 0.0)}
    assert judging.scored_choices(s, a, "k", keep_missing=False).count() == 2
