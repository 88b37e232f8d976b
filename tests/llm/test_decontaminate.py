"""Benchmark passages against all windows in plain Python."""

import hashlib
import random
import re

import pytest
from conftest_llm import rows_of

from factloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(x):
    return WORD.findall((x or "").translate(SMALL))


def brute(docs, items, window=10):
    of = {}
    for i, text in items:
        w = words(text)
        m = min(window, len(w))
        for at in range(len(w) - m + 1 if m else 0):
            of.setdefault(tuple(w[at : at + m]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for m in {len(g) for g in of}:
            for at in range(len(w) - m + 1):
                if found := of.get(tuple(w[at : at + m])):
                    hit |= set(range(at, at + m))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def scanned(spark, docs, items, **more):
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(map(tuple, decontaminate.scan(docs, b, **more).collect()), key=repr)


def texts(seed, n, vocabulary, longest):
    draw = random.Random(seed)
    return [" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("window", [1, 3, 10])
def test_few_words(spark, frame, window):
    """Few different words, so that windows recur, overlap and fill whole texts."""
    some = ["a", "b", "A.", "é", "7"]
    docs, items = list(enumerate(texts(window, 60, some, 90))), list(enumerate(texts(100 + window, 25, some, 25)))
    assert scanned(spark, frame([(i, t, "s") for i, t in docs]), items, window=window) == brute(docs, items, window)


def test_passages_of_every_length(spark, frame):
    draw, fresh = random.Random(3), [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(draw.sample(fresh, n))) for i, n in enumerate([*range(1, 16), 40, 200])]
    docs = []
    for i in range(150):
        passage = draw.choice(items)[1].split()
        at = draw.randrange(len(passage))
        docs.append((i, " ".join([*draw.sample(fresh, 30), *passage[at : at + draw.randrange(1, 25)], *draw.sample(fresh, 30)])))
    got = scanned(spark, frame([(i, t, "s") for i, t in docs]), items)
    assert got == brute(docs, items) and {r[5] for r in got} == {True, False}


def test_hard_rows(spark, hard, clashing):
    items = [(1, "same line, HERE again same line here again same line here"), (1, "one"), (2, "one two"), (None, "ONE"), (3, None), (4, " .. "), (5, "\U0001d518 é"), (5, "\U0001d518 é")]
    items += [(6, next(t for i, t in rows_of(hard) if i == 8))]
    expected = brute(rows_of(hard), items)
    assert scanned(spark, hard, items) == expected == scanned(spark, clashing, items)
    kept = decontaminate.without_contaminated(clashing, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == clashing.columns and kept.count() == sum(not r[5] for r in expected)


def test_empty_tables(spark, frame, hard):
    assert scanned(spark, frame([]), [(1, "one")]) == []
    assert scanned(spark, hard, []) == brute(rows_of(hard), [])


def test_beyond_the_broadcast_bound(spark, frame, monkeypatch):
    monkeypatch.setattr(decontaminate, "broadcast_if_small", lambda df: df.hint("merge"))
    docs, items = list(enumerate(texts(5, 40, ["a", "b", "c"], 60))), list(enumerate(texts(6, 20, ["a", "b", "c"], 30)))
    assert scanned(spark, frame([(i, t, "s") for i, t in docs]), items) == brute(docs, items)


def test_spans(spark, frame):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = frame([(1, f"x y {passage} z", "s"), (2, "x y", "s"), (3, f"{passage.replace('p15', 'q')}", "s")])
    got = decontaminate.spans(docs, spark.createDataFrame([(9, passage)], "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, 30, "9"), (3, 0, 15, "9"), (3, 16, 14, "9")]
