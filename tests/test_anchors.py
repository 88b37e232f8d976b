"""Anchors, tool texts and nested values against plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from factloom.functions import anchors, tool_text
from factloom.operators import nested


def spans(text, anchor):
    """Letter by letter as far as that goes, then by words."""
    anchor = anchor.strip()
    if not text or not anchor:
        return []
    out, at = [], 0
    loose = re.compile(r"\s+".join(map(re.escape, anchor.split())))
    while True:
        start = text.find(anchor, at)
        if start >= 0:
            end = start + len(anchor)
        elif m := loose.search(text, at):
            start, end = m.span()
        else:
            return out
        out.append((start, end))
        at = end


def test_spans(spark):
    draw = random.Random(1)
    rows = [("a  b a b", "a b"), ("a b c", " a b "), ("xa\t\nb", "a b"), ("a b", "a  b"), ("", "a"), ("a", ""), ("a.b (c) \\E d\\E", "\\E d"), ("𝔘 a b 𝔘", "a b 𝔘"), ("aaaa", "aa"), ("a+b? [c]", "+b? [")]
    for _ in range(300):
        text = "".join(draw.choice(["a", "b", ".", " ", "  ", "\t", "\n", "é"]) for _ in range(draw.randrange(60)))
        rows.append((text, "".join(draw.choice("ab. \n") for _ in range(draw.randrange(1, 5)))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, anchor string")
    got = {r.i: [tuple(s) for s in r.s] for r in df.select("i", anchors.anchor_spans("text", "anchor").alias("s")).collect()}
    assert got == {i: spans(*r) for i, r in enumerate(rows)}
    nulls = spark.createDataFrame([(None, "a"), ("a", None)], "text string, anchor string").select(anchors.anchor_span("text", "anchor").alias("s")).collect()
    assert [r.s for r in nulls] == [None, None]


def test_variants_and_best_anchor(spark):
    values = ["Option B is  the kinase that is activated, as shown. More", "the agent claims that it works; always", None]
    row = spark.createDataFrame([tuple(values)], "a string, b string, c string").select(anchors.anchor_variants("a", "b", "c").alias("v")).first()
    assert row.v == ["Option B is the kinase that is activated, as shown. More", "the kinase that is activated, as shown. More", "the kinase that is activated", "the kinase that is activated, as shown", "the agent claims that it works; always", "it works; always"]
    cases = [("c", "s  n", "st", "r", "s n"), ("b c", "", "[{'k': 1}]", "r", "b c"), ("", None, None, "because", "because"), ("", None, "  what", "r", "what"), ("x", "{'a': 1}", "A b. See x here. Z", "r", "See x here."), (None, None, None, None, "")]
    df = spark.createDataFrame(cases, "c string, s string, t string, r string, want string")
    for r in df.select("want", anchors.best_anchor("c", "s", "t", "r").alias("got")).collect():
        assert r.got == r.want


def test_records_come_back_from_their_text(spark):
    draw = random.Random(2)
    rows = [[{"title": f"T {draw.random()}", **{n: f"{n} {draw.random()}" for n in ("authors", "year", "doi", "venue", "snippet") if draw.random() < 0.7}} for _ in range(draw.randrange(4))] for _ in range(40)]
    names = {v: k for k, v in tool_text.LABELS.items()}
    texts = ["intro\n" + "\n".join(f"  [{i}] {r['title']}\n" + "".join(f"{names[n]} {v} \r\n" for n, v in r.items() if n != "title") for i, r in enumerate(record)) for record in rows]
    df = spark.createDataFrame([*enumerate(texts), (40, None), (41, "[1] x\nNo literature results found"), (42, "[1]\nYear: 1\n[2] b\nYear: 2\nYear: 3")], "k int, text string")
    got = {}
    for r in tool_text.records(df, "text", ["k"]).orderBy("k", "n").collect():
        got.setdefault(r.k, []).append({n: r[n] for n in ("title", *names) if r[n] is not None})
    assert got == {k: v for k, v in enumerate(rows) if v} | {42: [{"title": "b", "year": "3"}]}


def test_pages(spark):
    text = 'Search results for: "q"\n[1] http://a.b/c\n [2] https://d.e \n[3] ftp://x\nSnippets:\nfirst\n  second\nIf the snippets above do not help\nmore'
    df = spark.createDataFrame([(1, text), (2, "No results found\n[1] http://a"), (3, None), (4, "[1] http://z")], "k int, text string")
    got = [(r.k, r.url, r.snippet) for r in tool_text.pages(df, "text", ["k"]).orderBy("k", "n").collect()]
    assert got == [(1, "http://a.b/c", "first\n  second\n"), (1, "https://d.e", "first\n  second\n"), (4, "http://z", "")]


def strings(x, path="$"):
    if isinstance(x, str):
        return [(path, x)]
    if isinstance(x, dict):
        return [s for k, v in x.items() for s in strings(v, path + (f".{k}" if re.fullmatch(r"\w+", k, re.ASCII) else f"['{k}']"))]
    return [s for i, v in enumerate(x) for s in strings(v, f"{path}[{i}]")] if isinstance(x, list) else []


VALUES = [
    {"a": "x", "b": ["y", 1, None, True, {"c d": 'quote " back \\ slash \\" é 𝔘\n\t'}]}, "bare", 7, None, [], {}, [["deep", [["deeper"]]]], {"a": {"a": {"a": "a"}}, "e": "", "colon": "x: y", ":": ":"}, {"long": "\n\"" * 20_000},
]


def test_strings_with_paths(spark):
    df = spark.createDataFrame([*((i, json.dumps(v)) for i, v in enumerate(VALUES)), (100, None), (101, "{broken")], "i int, j string")
    got = sorted((r.i, r.path, r.text) for r in nested.walked(df, "j", ["i"]).collect())
    assert got == sorted((i, *s) for i, v in enumerate(VALUES) for s in strings(v))


def test_rewriting_changes_strings_alone(spark):
    def changed(x):
        if isinstance(x, str):
            return x.replace("e", "<e>")
        return {k: changed(v) for k, v in x.items()} if isinstance(x, dict) else [changed(v) for v in x] if isinstance(x, list) else x

    df = spark.createDataFrame([(i, json.dumps(v, indent=1 if i % 2 else None, ensure_ascii=i % 3 > 0)) for i, v in enumerate(VALUES)] + [(100, None)], "i int, j string")
    got = {r.i: (r.j, r.same, r.new) for r in df.select("i", "j", nested.rewritten("j", lambda s: s).alias("same"), nested.rewritten("j", lambda s: F.replace(s, F.lit("e"), F.lit("<e>"))).alias("new")).collect()}
    assert got[100] == (None, None, None)
    for i, v in enumerate(VALUES):
        assert json.loads(got[i][1]) == v and json.loads(got[i][2]) == changed(v)
