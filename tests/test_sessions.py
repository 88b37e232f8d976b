"""Stalls and lineages against plain loops, and stream against batch."""

import datetime
import random

from pyspark.sql import functions as F

from factloom.operators import sessions
from factloom.streaming import events

DAY = datetime.datetime(2024, 1, 1)


def stalls(polls, seconds):
    out, end = set(), max(t for _, t, _ in polls)
    for key in {k for k, _, _ in polls}:
        own = sorted((t, s) for k, t, s in polls if k == key)
        runs = [r for i, r in enumerate(own) if i == 0 or own[i - 1][1] != r[1]]
        for i, (t, s) in enumerate(runs):
            until = runs[i + 1][0] if i + 1 < len(runs) else end
            if (until - t).total_seconds() > seconds:
                out.add((key, s, t))
    return out


def test_stalls_in_batch_and_stream(spark, tmp_path):
    draw = random.Random(1)
    times = sorted(draw.sample(range(0, 200_000, 7), 400))
    rows = [(i, DAY + datetime.timedelta(seconds=t), draw.randrange(8), draw.choice("aaab"), 0.0, None) for i, t in enumerate(times)]
    path = str(tmp_path / "in")
    for i in range(0, 400, 80):  # files in order of time
        spark.createDataFrame(rows[i : i + 80], events.EVENT).coalesce(1).write.mode("append").parquet(path)
    polls = [(k, t, s) for _, t, k, s, _, _ in rows]
    want = stalls(polls, 5000)
    batch = sessions.signature_stalls(spark.read.parquet(path), "user_id", "ts", "event_type", 5000)
    assert {tuple(r) for r in batch.collect()} == want and 5 < len(want)
    stream = events.signature_stalls(events.event_stream(spark, path, "0 seconds"), "user_id", "ts", "event_type", 5000)
    events.appended(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    told = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    # what is open at the very end is told once time has passed it
    last = {x for x in want if not any(k == x[0] and t > x[2] and s != x[1] for k, t, s in polls)}
    assert len(told) == len(set(told)) and want - last <= set(told) <= want


def test_lineage_over_generations(spark):
    draw = random.Random(2)
    parent = {i: (draw.randrange(i), draw.randrange(40)) for i in range(1, 60) if draw.random() < 0.95}
    history = [(draw.randrange(60), draw.randrange(40), f"m{i}") for i in range(300)]
    want = []
    for viewer in range(60):
        at, cut = viewer, 10**9
        while True:
            want += [(s, t, x, viewer) for s, t, x in history if s == at and t < cut]
            if at not in parent:
                break
            at, cut = parent[at][0], min(cut, parent[at][1])
    resets = spark.createDataFrame([(s, p, c) for s, (p, c) in parent.items()] + [(None, 1, 2), (3000, None, 1)], "session int, parent int, cutoff int")
    got = sessions.visible(spark.createDataFrame(history, "session int, ts int, text string"), resets, "session", "ts")
    assert sorted(map(tuple, got.select("session", "ts", "text", "viewer").filter(F.col("viewer") < 60).collect())) == sorted(want)
    assert sessions.lineage(resets.limit(0)).count() == 0
