"""Sinks and run folders on local paths."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from factloom.operators import sampling
from factloom.sources import sinks


def test_results_are_rows_and_a_summary(spark, tmp_path):
    rows = spark.createDataFrame([(1, ("a", [1, 2]))], "id int, nested struct<x:string,y:array<int>>")
    sinks.write_results(rows, {"n": 1, "name": "é"}, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out/summary.json").read_text()) == {"n": 1, "name": "é"}
    assert '  "n": 1' in (tmp_path / "out/summary.json").read_text()
    assert spark.read.json(str(tmp_path / "out/results")).first().nested.y == [1, 2]


def test_rewrite_keeps_the_first_backup(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).write.json(path)
    for most in (3, 2):
        sinks.rewrite(spark.read.schema("id bigint").json(path).filter(F.col("id") < most), path)
    assert spark.read.json(path).count() == 2 and spark.read.json(f"{path}.bak").count() == 4
    left = sinks.compacted(spark, path, "id bigint", F.col("id") > 0)
    assert [r.id for r in left.collect()] == [1] and spark.read.json(f"{path}.bak").count() == 4


def test_a_rewrite_that_is_cut_off_loses_nothing(spark, tmp_path, monkeypatch):
    path, moves = str(tmp_path / "t"), []
    spark.range(4).write.json(path)
    move = sinks._move
    for n in (1, 2, 3):  # the nth rename fails

        def failing(fs, old, new, n=n):
            moves.append(new)
            if len(moves) == n:
                raise OSError("cut off")
            move(fs, old, new)

        moves.clear()
        monkeypatch.setattr(sinks, "_move", failing)
        try:
            sinks.rewrite(spark.read.json(path).select(F.col("id") + 10), path)
        except OSError:
            pass
        monkeypatch.setattr(sinks, "_move", move)
        sinks.recover(spark, path)
        assert spark.read.json(path).count() == 4
        spark.range(4).write.mode("overwrite").json(path)


def test_logs_grow_and_have_times(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(2):
        sinks.log_events(spark.createDataFrame([(i,)], "event int"), path)
    assert spark.read.json(path).filter("timestamp IS NOT NULL").count() == 2


def test_run_folders(spark, tmp_path):
    for name, files in (("b", ("rows", "summary")), ("a", ("rows", "summary")), ("c", ("rows",))):
        (tmp_path / name).mkdir()
        for f in files:
            Path(tmp_path / name / f).write_text("x")
    assert sinks.run_folders(spark, str(tmp_path), ("rows", "summary")) == ["a", "b"] and sinks.run_folders(spark, str(tmp_path / "none"), ("x",)) == []


def test_distractors_of_a_head_with_many_tails(spark):
    pool = [("h", "r", f"t{i:03}") for i in range(300)] + [("g", "r", t) for t in ("t000", "z1", "z2")] + [("k", "q", "only")]
    asked = [(1, "h", "r", "t005"), (2, "g", "r", "z1"), (3, "new", "r", "t001"), (4, "k", "q", "only"), (5, "x", "none", "a")]
    got = sampling.distractors(spark.createDataFrame(asked, "id int, head string, relation string, answer string"), spark.createDataFrame(pool, "head string, relation string, tail string"))
    assert {r.id: r.distractors for r in got.collect()} == {1: ["z1", "z2"], 2: ["t001", "t002", "t003"], 3: ["t000", "t002", "t003"], 4: [], 5: []}
