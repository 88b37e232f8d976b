"""Hard negatives against all scores in plain Python."""

import math
import random

import numpy as np
import pytest

from factloom.llm import negatives

ROWS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, anchor_every=50):
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    low = lambda i: negatives.NO_ID if i is None else i
    for n, (i, v, label) in enumerate(good):
        if i is None or i % anchor_every:
            continue
        every = [(-sum(x * y for x, y in zip(v, w, strict=False)), low(j), j, other) for m, (j, w, other) in enumerate(good) if m != n]
        every.sort(key=lambda x: x[:2])
        for p, _, j, _ in [x for x in every if x[3] == label][:5]:
            fit = [x for x in every if x[3] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(i, j, r, x[2], -p, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **more):
    got = negatives.mine(spark.createDataFrame(rows, ROWS), **more)
    assert [c for c, _ in got.dtypes] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 3, 5), (33, 64, 17), (40, 65, 70), (64, 128, 96)])
def test_products(shape):
    m, k, n = shape
    draw = np.random.default_rng(sum(shape))
    a, b = draw.integers(-(2**27), 2**27, (m, k)), draw.integers(-(2**27), 2**27, (k, n))
    assert (negatives.strassen(a, b, leaf=4) == a @ b).all()


def test_products_that_fit_though_sums_do_not():
    a = np.full((64, 64), 2**62)
    assert (negatives.strassen(a, np.eye(64, dtype=np.int64), leaf=8) == a).all()


def test_random_rows(spark):
    draw = random.Random(1)
    rows = [(i, [draw.gauss(0, 0.2) + 0.1 for _ in range(12)], draw.randrange(4)) for i in range(400)]
    assert mined(spark, rows) == brute(rows)


def test_groups_shards_and_tiles_do_not_matter(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, 0.2) + 0.1 for _ in range(5)], draw.randrange(3)) for i in range(300)]
    for name, value in (("GROUP", 7), ("SHARD", 40), ("TILE", 16), ("LEAF", 2)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows, anchor_every=5) == brute(rows, 5)


def test_hard_rows(spark):
    """Nulls, infinite and empty vectors, lengths that differ, negative scores, ties, repeated rows and ids."""
    same = [(i, [0.5, 0.5, 0.1], i % 2) for i in range(40)]
    rows = [
        *same, *same[:3], (50, [0.5, 0.4, 0.1], 0), (50, [0.5, 0.4, 0.1], 0), (50, [0.3], 1), (100, [], 1), (None, [0.45, 0.45, 0.1], 1), (150, None, 1),
        (200, [0.1, None, 0.2], 0), (250, [float("inf"), 0.0, 0.0], 0), (300, [float("nan")], 1), (350, [-0.5, -0.5, -0.5], 1), (400, [0.1, 0.2, 0.3], None), (-50, [0.9, 0.9, 0.9, 0.9], 1),
        (None, [0.35, 0.35, 0.1], 0),
    ]
    got = mined(spark, rows)
    assert got == brute(rows) and len({r[0] for r in got}) >= 3


def test_empty_tables_and_other_columns(spark):
    from pyspark.sql import functions as F

    assert mined(spark, []) == [] == mined(spark, [(1, [0.1], 1)])
    rows = [(i, [0.5, 0.1 * (i % 5)], i % 3) for i in range(120)]
    names = ["row", "k", "v", "g", "s", "rank", "score", "place", "low"]
    wide = spark.createDataFrame(rows, ROWS).select("*", *(F.lit("x").alias(n) for n in names))
    assert sorted(map(tuple, negatives.mine(wide).collect()), key=repr) == brute(rows)
