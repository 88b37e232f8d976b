"""Joins over vectors and entity fusion against all pairs in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import graph, vectors

ROWS = "id bigint, kind string, vector array<double>"


def cosine(a, b):
    if not a or not b or len(a) != len(b) or any(x is None or not np.isfinite(x) for x in [*a, *b]):
        return 0.0
    a, b = np.array(a), np.array(b)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(a @ b / n), 9) if n else 0.0


def pairs(rows, floor):
    agree = lambda a, b: not a or not b or a == b
    return {(a, b) for a, k, v in rows for b, h, w in rows if a < b and agree(k, h) and cosine(v, w) >= floor}


def groups(nodes, links):
    of = {n: n for n in nodes}
    for a, b in links:
        old, new = max(of[a], of[b]), min(of[a], of[b])
        of = {n: new if g == old else g for n, g in of.items()}
    return of


def clustered(seed, n, width=6):
    draw = np.random.default_rng(seed)
    middles = draw.standard_normal((8, width))
    return [(i, ["a", "b", None, ""][int(draw.integers(4))], (middles[draw.integers(8)] + 0.25 * draw.standard_normal(width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 9])
def test_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = clustered(1, 220)
    df = spark.createDataFrame(rows, ROWS)
    for floor in (0.9, 0.98):
        want = pairs(rows, floor)
        got = vectors.alike(df, floor).collect()
        assert sorted((r.u, r.v) for r in got) == sorted(want) and want
        links = {(r.u, r.v) for r in vectors.alike(df, floor, links=True).collect()}
        assert groups(range(220), links) == groups(range(220), want)


def test_far_blocks_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    df = spark.createDataFrame([(i, "a", v) for i, _, v in clustered(2, 400)], ROWS)
    blocks = vectors._blocks(df.mapInArrow(vectors._projected, "id bigint, kind string, vector array<double>, shadow array<double>"))
    n = blocks.select("block").distinct().count()
    assert vectors._meeting(blocks, 0.99).count() < 0.7 * n * (n + 1) / 2


def test_equal_and_odd_vectors(spark):
    """A large group of equal vectors is a star; nulls, zeros, empty and non-finite vectors and other lengths match nothing."""
    rows = [(i, "a", [1.0, 2.0]) for i in range(300)] + [(300, None, [2.0, 4.0]), (301, "b", [1.0, 2.0]), (302, "a", None), (303, "a", [0.0, 0.0]), (304, "a", []), (305, "a", [1.0, 2.0, 0.0]), (306, "a", [float("nan"), 1.0]), (307, "a", [None, 1.0])]
    got = {(r.u, r.v) for r in vectors.alike(spark.createDataFrame(rows, ROWS), 0.9).collect()}
    assert got == {(0, i) for i in range(1, 300)} | {(0, 300), (300, 301)}
    assert vectors.alike(spark.createDataFrame([], ROWS), 0.9).count() == 0


def test_fusion(spark):
    draw = random.Random(4)
    rows = clustered(5, 150)
    nodes = [(i, draw.choice(["Alpha", " alpha", "beta  two", f"n{i}", f"n{i} x", None, ""]), k, v) for i, k, v in rows]
    key = lambda x: " ".join((x or "").lower().split())
    same = {(a[0], b[0]) for a in nodes for b in nodes if a[0] < b[0] and key(a[1]) and key(a[1]) == key(b[1])}
    of = groups(range(150), pairs(rows, 0.985) | same)
    got = {r.node: r for r in graph.fused(spark.createDataFrame(nodes, "node bigint, name string, type string, vector array<double>"), 0.985).collect()}
    assert {n: r.group for n, r in got.items()} == of and 1 < len(set(of.values())) < 150
    for g in set(of.values()):
        members = [n for n in nodes if of[n[0]] == g]
        names = [n[1] for n in members if n[1]]
        assert got[g].size == len(members) and got[g].node_type == next((n[2] for n in members if n[2]), None)
        if names:
            best = max(names, key=lambda x: (len(key(x).split()), len(x), x.lower()))
            assert (len(key(got[g].canonical).split()), len(got[g].canonical), got[g].canonical.lower()) == (len(key(best).split()), len(best), best.lower())


def test_floats_are_sent_as_floats(spark, monkeypatch):
    """Vectors of floats meet as such, half as wide as doubles, with the same links."""
    from factloom.operators import vectors as V

    kinds, blocks = [], V._blocks
    monkeypatch.setattr(V, "_blocks", lambda rows: kinds.append(dict(rows.dtypes)["vector"]) or blocks(rows))
    rows = spark.range(60).select("id", F.lit("k").alias("kind"), F.array(*(F.sin(F.col("id") * (i + 1)) for i in range(6))).alias("vector"))
    single = rows.withColumn("vector", F.col("vector").cast("array<float>"))
    got = [sorted((r.u, r.v, r.similarity) for r in V.alike(x, 0.7).collect()) for x in (single, single.withColumn("vector", F.col("vector").cast("array<double>")))]
    assert kinds == ["array<float>", "array<double>"] and got[0] == got[1] and got[0]
