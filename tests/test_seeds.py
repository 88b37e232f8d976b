"""Seeds: cleaning, compounds and reasons on marked candidates; entities and triples of items against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import seeds
from factloom.operators import benchmark

RULES = seeds.SeedRules(
    openings=("what is", "how do"), tails=("using", "in"), kinds={"domains": "domain", "proteins": "protein"}, generic=("protein", "study"), bad_starts=("role",),
    light=("of", "that", "is"), aspects=("structure",), phrases=("as a",),
)


@pytest.mark.parametrize(
    "raw,want",
    [
        ("What is how do the  Kh1 domain?", "Kh1 domain"), ("a motor using light in water", "motor"), ("role of the Min D2 ring", "D2 ring"), ("D2 ring", "D2 ring"), (None, ""), (" .,;", ""), ("what is", "what is"),
        ("we saw the old clock proteins and others", "we saw old clock proteins"), ("ein Öl-Ring", "Öl-Ring"), ("usings of ink", "usings of ink"),
    ],
)
def test_cleaned(spark, raw, want):
    assert spark.range(1).select(seeds.cleaned(RULES, F.lit(raw).cast("string"))).first()[0] == want


@pytest.mark.parametrize(
    "name,want",
    [("LOV and the KH1 domains", ["LOV and the KH1 domains", "LOV domain", "KH1 domain"]), ("Smc5 and Smc6", ["Smc5 and Smc6", "Smc5", "Smc6"]), ("a and a", ["a and a", "a"]), ("ring", ["ring"]), ("", []), ("one and two three", ["one and two three"])],
)
def test_compounds(spark, name, want):
    assert spark.range(1).select(seeds.compounds(RULES, F.lit(name))).first()[0] == want


@pytest.mark.parametrize(
    "name,why",
    [("", "empty"), ("Protein", "generic"), ("ab", "short"), ("1234", "number"), ("role D2", "start"), ("a b c d e f g", "long"), ("that is D2", "sentence"), ("D2 structure", "aspect"), ("D2 as a ring", "phrase"),
     ("blue ring", "no_sign"), ("rings", "no_sign"), ("kinesin", None), ("blue domain", None), ("E/F", None), ("p53", None), ("structure", None)],
)
def test_one_reason(spark, name, why):
    assert spark.range(1).select(seeds.useless(RULES, F.lit(name))).first()[0] == why


def test_no_rules(spark):
    v = seeds.SeedRules()
    assert spark.range(1).select(seeds.useless(v, F.lit("p53 of that")), seeds.canonical(v, F.lit("Domains x")), seeds.cleaned(v, F.lit("the p53 using"))).first()[:] == (None, "Domains x", "p53 using")


def test_items_against_plain_loops(spark):
    """Names as they come, once each, twelve at most; triples between them, else loops."""
    r = random.Random(3)
    names = [f"P{i}" + ("x" if i % 2 else "") for i in range(20)] + ["ab", "", None, "p1x", "Domains P9"]
    items = [(i, [r.choice(names) for _ in range(r.randint(0, 25))] if i % 9 else None, [r.choice(names) for _ in range(r.randint(0, 3))]) for i in range(40)]
    asked = [(i, r.choice(names), r.choice(["Binds to", " ", None, "x"]), r.choice(names), r.choice(["0.9", "0.6", "0.59", "high", None]), n) for n, i in enumerate(r.choices(range(45), k=400))]
    keys = lambda x: " ".join((x or "").lower().replace("domains", "domain").split())
    drop = lambda x: len(keys(x)) < 3 and not any(c.isdigit() for c in x or "") or len(keys(x)) < 3
    cut = lambda x: (x or "").replace("Domains ", "")
    wanted, triples = {}, []
    for i, first, second in items:
        held = {}
        for name in (first or []) + second:
            if not drop(cut(name)):
                held.setdefault(keys(cut(name)), cut(name))
        if held:
            wanted[i] = dict(list(held.items())[:12])
    for i, head, rel, tail, conf, _ in asked:
        h, t = (wanted.get(i, {}).get(keys(cut(x))) for x in (head, tail))
        if (rel or "").strip() and conf in ("0.9", "0.6") and h and t and h != t:
            triples.append((i, h, rel.strip().lower().replace(" ", "_"), t, float(conf), "proposed"))
    for i, held in wanted.items():
        if not any(x[0] == i for x in triples):
            triples += [(i, n, benchmark.SELF_LOOP, n, 0.9, "single" if len(held) == 1 else "fallback") for n in held.values()]
    rows = spark.createDataFrame(items, "item int, a array<string>, b array<string>").repartition(3)
    got = benchmark.item_entities(RULES, rows.withColumns({"name": F.lit("x"), "place": F.lit(1), "key": F.lit("k")}), "item", [F.col("a"), F.col("b")])
    assert {x["item"]: {n["key"]: n["name"] for n in x.names} for x in got.collect()} == wanted
    found = benchmark.accepted(RULES, got, spark.createDataFrame(asked, "item int, head string, relation string, tail string, confidence string, seq int"), "item")
    assert sorted(tuple(x) for x in found.collect()) == sorted(triples)
    none = benchmark.accepted(RULES, got.limit(0), found.limit(0).withColumn("seq", F.lit(1)), "item")
    assert none.count() == 0


def test_runs_are_found_in_one_look(spark):
    """The same runs as the SQL's pattern gives, and a long word isn't read again from each of its letters."""
    import re
    import time

    from factloom.queries import items

    r = random.Random(8)
    texts = ["".join(r.choice("aabzA1/-: .é\n") for _ in range(r.randrange(60))) for _ in range(400)]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").select("id", items._found().alias("f")).collect()
    assert {x.id: x.f for x in found} == {i: re.findall(items._RUN, t) for i, t in enumerate(texts)}
    began = time.time()
    long = spark.createDataFrame([("b" * 400_000 + " Aba x1",)], "text string")
    assert long.select(items._found().alias("f")).first().f == ["Aba x1"] and time.time() - began < 20


def test_steps_equal_one_expression(spark):
    """Cleaned in projections, judged by columns: as ``cleaned`` and ``useless`` say of a name alone, whatever its spaces."""
    r = random.Random(9)
    words = ["what", "is", "the", "a", "and", "Kh1", "domain", "Domains", "D2", "in", "ring", "Öl-Ring", "protein", "PROTEINS", "role", "of", " ", "\t", "(x", "p53.", "aB"]
    rows = [(i, [" ".join(r.choices(words, k=r.randrange(1, 9)))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, found array<string>")
    got = benchmark.candidates(RULES, df, "id", F.col("found")).collect()
    one = df.select("id", F.explode("found").alias("raw")).select("id", F.posexplode(seeds.compounds(RULES, seeds.cleaned(RULES, F.concat("raw", F.lit("")))))).select("id", "pos", seeds.canonical(RULES, F.concat("col", F.lit(""))).alias("n"))
    want = one.select("id", "pos", "n", seeds.useless(RULES, "n").alias("why")).collect()
    assert len(got) > 300 and {(x.id, x.place.part): (x.name, x.reason) for x in got} == {(x.id, x.pos): (x.n, x.why) for x in want}


def test_neighbours_of_one_cleaning(spark):
    """As ``accepted`` gives of the same neighbours cleaned again; and a reason that is looked at twice is judged once."""
    r = random.Random(11)
    words = ["what", "the", "a", "and", "Kh1", "kH1", "domain", "Domains", "D2", "in", "ring", "protein", "PROTEINS", "role", "abcdefg", "Abcdefg", "(x", "p53.", "x and D2"]
    rows = [(i, [" ".join(r.choices(words, k=r.randrange(1, 5))) for _ in range(r.randrange(12))]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, found array<string>")
    confidence = lambda at: (F.col("id") * 31 + at * 7) % 10 / 10
    named = benchmark.candidates(RULES, df, "id", F.col("found"))
    asked = spark.createDataFrame([(i, k, a, "Is near", b) for i, f in rows for k, (a, b) in enumerate(zip(f, f[1:]))], "id long, seq int, head string, relation string, tail string")
    want = benchmark.accepted(RULES, benchmark.item_entities(RULES, df, "id", [F.col("found")]), asked.withColumn("confidence", confidence(F.col("seq"))), "id").collect()
    got = benchmark.accepted_neighbours(named, "id", "is_near", confidence).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {x.how for x in got} == {"proposed", "single", "fallback"}
    plan = named.filter("reason IS NULL OR reason = 'start'").select("id", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("THEN number") == 1
