"""Vocabularies, claims, evidence, vectors and Python-side functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import claims as C
from factloom.functions import python_side as P
from factloom.functions import vocab as V
from factloom.operators import evidence, vectors


def one(spark, values, make, schema=None):
    schema = schema or ", ".join(f"x{i} string" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], schema).select(make(*(F.col(f"x{i}") for i in range(len(values)))).alias("y")).first()["y"]


WORDS = V.Vocabulary(
    types=(V.Rule("exact", "nse", "Complex"), V.Rule("ends", " pathway", "Pathway"), V.Rule("finds", r"(?i)\bkinase\b", "Protein")),
    type_names={"protein_domain": "Protein"}, relations={"binds": "interacts_with"}, allowed=("interacts_with", "associated_with", "improves", "inhibits"), aliases={"p53": "TP53"},
    association_hints=("correlated",), improvement_hints=("better",),
)


@pytest.mark.parametrize(("raw", "name", "want"), [("x", "NSE", "Complex"), ("", "Wnt  pathway", "Pathway"), ("Gene", "a Kinase b", "Protein"), ("protein domain", "z", "Protein"), ("Odd", "z", "Odd"), ("", "", "Entity"), (None, None, "Entity")])
def test_types(spark, raw, name, want):
    assert one(spark, (raw, name), lambda r, n: V.entity_type(WORDS, r, n)) == want


@pytest.mark.parametrize(
    ("normalized", "surface", "tail", "kind", "told", "want"),
    [
        ("binds", "", "b", "", "", "interacts_with"), ("part_of", "recruits", "b", "", "", "associated_with"), ("part of", "mediated", "b", "", "", "involved_in"), ("regulates expression of", "silences", "b", "", "", "downregulates"),
        ("promotes", "", "Wnt pathway", "", "", "involved_in_pathway"), ("associated_with", "", "survival", "ClinicalEndpoint", "it was better", "improves"), ("odd", "odd", "b", "", "was correlated", "associated_with"), ("odd", None, "b", "", None, ""),
    ],
)
def test_relations(spark, normalized, surface, tail, kind, told, want):
    assert one(spark, (normalized, surface, tail, kind, told), lambda *a: V.relation(WORDS, *a)) == want


def test_names_by_the_evidence(spark):
    told = "We saw tumor necrosis factor (TNF) and interleukin six (XYZ)."
    assert one(spark, (told,), V.abbreviations) == {"tnf": "We saw tumor necrosis factor"}
    assert one(spark, ("tnf", told), lambda n, e: V.entity_name(WORDS, n, e)) == "We saw tumor necrosis factor"
    assert one(spark, ("P53.", None), lambda n, e: V.entity_name(WORDS, n, e)) == "TP53"


def test_variants(spark):
    got = one(spark, ("Gene Set Test",), lambda t: V.keyword_variants(t, {"gene set test": ["GST one"]}, {"test": ["assay"]}, ("cells",)))
    assert [(r.variant, r.how) for r in got] == [("GST one", "synonym"), ("Gene Set assay", "replacement"), ("Gene Set Test cells", "suffix"), ("GST", "acronym")]


def test_claims(spark):
    assert one(spark, ("The p53 study of p53, and TNF-a",), C.relevance_terms) == ["p53", "tnf-a"]
    assert one(spark, ("p53 binds mdm2 tightly", "mdm2 and P53"), C.is_relevant) and not one(spark, ("p53 binds mdm2 tightly", "nothing"), C.is_relevant)
    assert not one(spark, ("p53", None), C.is_relevant) and one(spark, ("the", "x"), C.is_relevant)
    assert one(spark, ("an NS3-protease", "ns3"), C.mentions) and not one(spark, ("dp7k", "p7"), C.mentions) and not one(spark, ("a", ""), C.mentions)
    assert one(spark, ("a b c d e", "x e d c b y"), C.is_supported) and not one(spark, ("a b c d e", "x c b y"), C.is_supported) and not one(spark, ("a", None), C.is_supported)
    assert one(spark, ("According to [1], what binds TP53?", "tp53"), C.leaks) and not one(spark, ("According to TP53 work, what binds?", "tp53"), C.leaks)
    assert one(spark, ("a", "part_of", "b", "weak"), C.claim_text) == "The evidence suggests a reported association involving a and b."
    options = [("x", True), ("y", False)]
    assert one(spark, (options, "X"), C.options_valid, "x0 array<struct<text:string,is_correct:boolean>>, x1 string")
    assert not one(spark, ([("x", True), ("x ", False)], "X"), C.options_valid, "x0 array<struct<text:string,is_correct:boolean>>, x1 string")
    assert one(spark, ("x",), lambda x: C.failed(a=x == "x", b=x == "y", c=F.lit(None).cast("boolean"))) == ["b", "c"]


def test_articles(spark):
    body = "Abstract. " + "This sentence of the article about proteins is long enough to count as one here. " * 20
    assert one(spark, (body, "Proteins"), C.is_article) and not one(spark, (body, "Galaxies"), C.is_article) and not one(spark, (body[:300], "Proteins"), C.is_article)
    page = "<p>Log in | " + "A piece of text that is long enough to be kept in the page. | " * 2 + "short</p>"
    assert one(spark, (page,), C.landing_text) == "A piece of text that is long enough to be kept in the page."


def test_layers_and_caches(spark):
    rows = spark.createDataFrame([(i,) for i in range(4)], "k int")
    layer = lambda *r: spark.createDataFrame(list(r), "k int, evidence string")
    got = {r.k: (r.evidence, r.layer) for r in evidence.first_layer(rows, "k", [("a", layer((0, "x"), (1, ""))), ("b", layer((0, "y"), (1, "z"), (1, "w")))]).collect()}
    assert got == {0: ("x", "a"), 1: ("w", "b"), 2: ("", "none"), 3: ("", "none")}
    cache = spark.createDataFrame([(1, "v")], "k int, value string")
    held, missing = evidence.cache_split(rows.union(rows), cache, "k")
    assert held.count() == 2 and {r.k for r in missing.collect()} == {0, 2, 3} and missing.count() == 3
    assert [(r.k, r.evidence, r.place) for r in evidence.bundled([layer((0, "b")), layer((0, "a"), (0, "b"))], "k", 2).orderBy("place").collect()] == [(0, "b", 1), (0, "a", 2)]
    papers = spark.createDataFrame([(0, "abs"), (1, " "), (2, None)], "paper_id int, abstract string")
    texts = spark.createDataFrame([(2, "full")], "paper_id int, text string")
    assert {(r.paper_id, r.text, r.text_source, r.has_fulltext) for r in evidence.acquired(papers, [("xml", texts)]).collect()} == {(0, "abs", "abstract", False), (1, "", "missing", False), (2, "full", "xml", True)}


def test_proposals(spark):
    raw = spark.createDataFrame([("t", "a", d) for d in "xxy"] + [("t", "b", d) for d in "xyz"] + [("t", "c", "x")], "kind string, key string, doc_id string")
    verdicts = spark.createDataFrame([("t", "b", "accept"), ("t", "c", "accept")], "kind string, key string, decision string")
    assert {r.key: r.outcome for r in evidence.proposals(raw, verdicts).collect()} == {"a": "reject", "b": "accept", "c": "too_few"}


def test_permutations_depend_on_the_key_alone(spark):
    df = spark.range(50).select("id", evidence.permuted(F.array(*map(F.lit, "abcd")), F.col("id"), "s").alias("o"))
    first = {r.id: tuple(r.o) for r in df.collect()}
    assert first == {r.id: tuple(r.o) for r in df.repartition(3).collect()} and len(set(first.values())) > 10 and all(sorted(v) == list("abcd") for v in first.values())


@pytest.mark.parametrize("block", [4096, 2])
def test_nearest(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    m = np.random.default_rng(1).standard_normal((40, 5)).astype(np.float32)
    m[7] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vector array<float>")
    got = {(r["query"], r.id) for r in vectors.nearest(df.filter("id < 6"), df, 2).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(6) for i in sorted((i for i in range(40) if i != q), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:2]}
    assert got == want and (3, 7) in got
    assert vectors.nearest(df.limit(0), df).count() == 0


def test_python_side(spark):
    text = "First part. " + "word " * 30 + "end. Second one? " + "more " * 30
    found = P.blocks(text, 100, 10)
    assert all(len(b) <= 100 for b in found) and found[0].startswith("First") and found[-1].endswith("more") and P.blocks(None) == []
    assert P.first_json('say {bad} then {"a": [1, 2]} more') == '{"a": [1, 2]}' and P.first_json(None) is None
    assert P.functions_of("def f():\n  'doc'\n  return 1\n\nclass A:\n  def g(self): pass\n") == [("f", 1, 3, "doc")] and P.functions_of("def (") == []
    assert [r.name for r in spark.createDataFrame([("def f(): pass\ndef g(): pass",)], "s string").lateralJoin(P.ModuleFunctions(F.col("s").outer())).collect()] == ["f", "g"]
    assert P.spliced("abcdef", [(1, 3, "X"), (2, 4, "no"), (4, 6, "")]) == "aXd"
    row = spark.createDataFrame([("abc", [(0, 1, "Z")]), (None, None)], "t string, s array<struct<start:int,end:int,text:string>>")
    assert {r[0] for r in row.select(P.splice("t", "s")).collect()} == {"Zbc", ""}
    c = spark.createDataFrame([(1, 1, "one two", 0.9, [1.0, 0.0]), (1, 2, "one too", 0.8, [0.99, 0.01]), (1, 3, "three", 0.7, [0.0, 1.0])], "claim int, id int, text string, similarity double, vector array<double>")
    assert {r.id for r in P.diverse(c, "claim").collect()} == {1, 3}


def test_registry(spark):
    from factloom import registry

    assert len(registry.QUERIES) > 50 and set(registry.SQL) <= set(registry.QUERIES)
