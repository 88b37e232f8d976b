"""Questions on images and frontiers with notes against plain loops."""

import random

from factloom.operators import graph, overlay

TRIPLES = "doc_id string, chunk_id string, head string, tail string, evidence string, seq int"


def image_key(doc_id, index):
    s = doc_id or ""
    while s.startswith("benchmark::"):
        s = s[11:]
    parts = s.split("::")
    return next((k for i in range(len(parts)) if (k := "::".join(parts[i:])) in index), None)


def test_image_questions(spark):
    draw = random.Random(1)
    index = {f"Set::test::f{i}::{i % 3}": f"img/{i}" for i in range(40)} | {"7": "short", "f9::0": "shorter"}
    rows = []
    for i in range(300):
        n = draw.randrange(60)
        doc = draw.choice(["", "benchmark::", "benchmark::benchmark::", "benchmark::Set::test::"]) + draw.choice([f"Set::test::f{n}::{n % 3}", f"x::f{n}::{n % 3}", str(n), "", f"Set::::f{n}"])
        rows.append((doc, None, "A b", draw.choice(["a B", "A b", "c"]), draw.choice([f"Q: what {i}?\nA: that", "Q: is it?\n a : Yes.", "no question", "\nA: x", None, f"q:x{i}\nA:  "]), i))
    rows += [(None, None, None, None, "Q: a\nA: b", 1000), *rows[:5]]
    images = spark.createDataFrame([*index.items(), ("7", "zzz")], "image_key string, path string")
    got = {r.image_key: r for r in overlay.image_questions(spark.createDataFrame(rows, TRIPLES), images).collect()}
    want = {}
    for doc, _, head, tail, evidence, _ in sorted(rows, key=lambda r: r[5]):
        key = image_key(doc, index)
        q, _, a = (evidence or "").replace("\n a :", "\nA:").partition("\nA:")
        if key and (head or "").lower() == (tail or "").lower() and q.strip() and a.strip():
            want.setdefault(key, (doc, q.strip()[2:].strip(), a.strip()))
    assert {k: (r.doc_id, r.question, r.answer) for k, r in got.items()} == want and len(want) > 10
    assert all(r.image_path == index[k] and r.answer_format == ("yesno" if r.answer == "Yes." else "open") for k, r in got.items())
    assert overlay.image_questions(spark.createDataFrame([], TRIPLES), images).count() == 0


def walk(seeds, links, rounds, cap, min_length):
    out = [(t, None, 0, n, True, "") for n, t in enumerate(sorted(seeds))]
    seen, frontier = set(seeds), sorted(seeds)
    for i in range(1, rounds + 1):
        new = []
        for parent in frontier:
            for term in sorted({b for a, b in links if a == parent}):
                why = ["min_length"] * (len(term) < min_length) + ["duplicate"] * (term in seen) + ["max_terms"] * (len(out) >= cap)
                out.append((term, parent, i, len(out), not why, "; ".join(why)))
                if not why:
                    seen.add(term)
                    new.append(term)
        frontier = new
    return out


def test_frontier_with_notes(spark):
    draw = random.Random(2)
    names = [f"{c}{i}"[: draw.randrange(1, 4)] for i in range(40) for c in "ab"]
    links = [(draw.choice(names), draw.choice(names)) for _ in range(200)]
    table = spark.createDataFrame([*links, *links[:9], (None, "a"), ("a", None)], "term string, next string")
    seeds = sorted({a for a, _ in links})[:3]
    for cap, least in ((25, 2), (1000, 0), (2, 0)):
        got = graph.expanded_with_notes(spark.createDataFrame([(s,) for s in [*seeds, seeds[0]]], "term string"), table, 4, cap, least)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == walk(seeds, links, 4, cap, least)
