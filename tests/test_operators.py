"""Operators on small tables, folds against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import dedup, graph, reports, sampling, selection, triples, turns
from factloom.plans import components as plan
from factloom.plans.components import connected_components, joined_by_hub
from factloom.plans.storage import stored
from factloom.plans.ranks import percent_rank, running_total

TRIPLE = "doc_id string, chunk_id string, head string, head_type string, surface_relation string, normalized_relation string, tail string, tail_type string, confidence double, evidence string, source string, seq bigint"


def facts(spark, rows):
    full = [(d, c, h, "Gene", r, r, t, "Gene", f, e, "paper", i) for i, (d, c, h, r, t, f, e) in enumerate(rows)]
    return spark.createDataFrame(full, TRIPLE)


def test_dedup_is_the_fold(spark):
    draw = random.Random(4)
    rows = [(f"d{draw.randrange(3)}", f"c{i}", "a", draw.choice(["r", "s"]), "b", draw.choice([0.2, 0.5, 0.9]), "e" * draw.randrange(5) + str(i % 3)) for i in range(60)]
    want: dict = {}
    for i, (d, c, _, r, _, f, e) in enumerate(rows):
        old = want.get((d, r))
        if old is None:
            want[d, r] = [c, f, i, e]
        elif f > old[1]:
            old[1], old[3] = f, e
        elif len(e) > len(old[3]):
            old[3] = e
    got = {(r.doc_id, r.normalized_relation): [r.chunk_id, r.confidence, r.seq, r.evidence] for r in triples.deduplicated(facts(spark, rows)).collect()}
    assert got == want


def test_passive_statements_turn(spark):
    row = triples.activated(facts(spark, [("d", "c", "x", "Inhibited by", "y", 0.9, "")])).first()
    assert (row["head"], row["normalized_relation"], row["tail"]) == ("y", "inhibits", "x")


@pytest.mark.parametrize(("head", "tail", "why"), [("", "b", "incomplete"), ("A", "a ", "self_loop"), ("Smith et al", "b", "generic"), ("cells", "b", "generic"), ("a b c or d e", "b", "sentence"), ("a", "b", None)])
def test_drop_reasons(spark, head, tail, why):
    row = triples.normalized(facts(spark, [("d", "c", head, "binds", tail, 0.9, "")]), generic=("cells",)).first()
    assert row.drop_reason == why


def test_confidence_at_the_threshold_is_dropped(spark):
    assert triples.normalized(facts(spark, [("d", "c", "a", "r", "b", 0.5, "")])).count() == 0


def test_later_documents_replace_edges(spark):
    local = triples.local_edges(facts(spark, [("d1", "1", "a", "r", "b", 0.5, "x"), ("d1", "2", "a", "r", "b", 0.4, "y"), ("d2", "1", "a", "r", "b", 0.3, "z")]))
    last, total = triples.global_edges(local).first(), triples.global_edges(local, "sum").first()
    assert (last.weight, list(last.evidence), last.doc_id) == (0.3, ["z"], "d2") and total.weight == pytest.approx(1.2) and total.n_docs == 2


def test_support_counts_sources(spark):
    rows = [("d1", "1", "a", "r", "b", 0.5, "x"), ("d1", "1", "a", "r", "b", 0.5, "y"), ("", "", "a", "r", "b", 0.5, "z"), ("", "", "a", "r", "b", 0.5, " z "), ("", "", "a", "r", "b", 0.5, "")]
    row = triples.support(facts(spark, rows), "head").first()
    assert (row.support_count, row.doc_count) == (2, 1)


def test_paths(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "s", "c"), ("b", "s", "a"), ("c", "t", "d"), ("c", "t", "a")], "head string, normalized_relation string, tail string")
    assert {(r["head"], r["pivot"], r["tail"]) for r in triples.two_hops(e).collect()} == {("a", "b", "c"), ("b", "c", "d"), ("b", "c", "a"), ("c", "a", "b")}
    assert {(r["head"], r["end"]) for r in triples.three_hops(e).collect()} == {("a", "d")}


def test_lookup_strategies(spark):
    exact = spark.createDataFrame([("Alpha", 1.0)], "name string, value double")
    alias = spark.createDataFrame([("First", "Alpha")], "alias string, name string")
    rows = spark.createDataFrame([("Alpha",), (" alpha",), ("FIRST",), ("none",)], "k string")
    got = {r.k: (r.value, r.strategy) for r in triples.with_fallbacks(rows, "k", exact, alias).collect()}
    assert got == {"Alpha": (1.0, "exact"), " alpha": (1.0, "canonical"), "FIRST": (1.0, "alias"), "none": (None, "not_found")}


def test_support_deals_rows_once_by_key_and_document(spark):
    rows = [("d1", "c1", "x", 0.5, 3), ("d1", "c2", "y", 0.5, 1), ("d1", "c1", "z", 1.0, 2), (None, None, "one", None, 4), ("", "", "two", 0.0, 5), (" ", None, "", 0.25, 6)]
    rows += [(None, None, f"said {i % 30}", None, 10 + i) for i in range(60)]
    table = spark.createDataFrame([("a", *r) for r in rows], "head string, doc_id string, chunk_id string, evidence string, confidence double, seq long")
    found = triples.support(table, "head", wording=("evidence",))
    r = found.first()
    assert (r.support_count, r.doc_count, r.chunk_count, r.avg_confidence, r.max_confidence, r["first"].evidence) == (34, 1, 2, 0.45, 1.0, "y")
    # to (key, document), and to the key
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2


def test_plain_text_is_normal(spark):
    texts = ["", " ", "a", "a b", "a  b", " a", "a ", "a\n", "a\nb", "a\u00a0b", "a\u0000b", "\u0000", "Stra\u00dfe", "A_b c~!", "a\tb", "\u2003x", None]
    table = spark.createDataFrame([(x,) for x in texts], "x string")
    got = table.select("x", text.normalize_text("x").alias("whole"), text.normalize_text(F.col("x")).alias("slow"), text.entity_key("x").alias("key")).collect()
    assert all(r.whole == r.slow for r in got) and {r.x: r.key for r in got}["Stra\u00dfe"] == "strasse"
    assert {r.x: r.whole for r in got}["a\u00a0b"] == "a b"


def test_unread_evidence_of_edges_is_not_collected(spark):
    rows = [("d1", "a", "b", "r", 0.5, "first", "s", 1), ("d2", "a", "b", "r", None, "second", "t", 2), ("d2", "a", "c", "r", 0.25, "third", "t", 0)]
    table = spark.createDataFrame(rows, "doc_id string, head string, tail string, normalized_relation string, confidence double, evidence string, source string, seq long")
    local = triples.local_edges(table)
    for order in (None, triples.document_order(table)):
        found = triples.global_edges(local, order=order)
        # d2 comes first by its other row, so that d1 is the last; all columns are of one row
        assert {r.tail: (r.weight, r.max_confidence, r.evidence, r.sources, r.doc_id) for r in found.collect()} == {"b": (0.5, 0.5, ["first"], ["s"], "d1"), "c": (0.25, 0.25, ["third"], ["t"], "d2")}
        assert "collect" not in found.select("head", "tail", "weight", "doc_id")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_components_of_hubs(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(50, i) for i in range(51, 60)] + [(39, 50)], "u bigint, v bigint")
    for hub in (2, 1000):
        got = {r.node: r.component for r in connected_components(edges, hub=hub).collect()}
        assert got == dict.fromkeys([*range(40), *range(50, 60)], 0)


def test_components_contract(spark, monkeypatch):
    rows = {}

    def kept(df, label):
        out = stored(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(plan, "stored", kept)
    # names, not numbers: orders of customers, and parts of several suppliers
    orders = spark.range(3000).select(F.format_string("order %d", "id").alias("u"), F.format_string("customer %d", F.col("id") % 300).alias("v"))
    parts = spark.range(6000).select(F.format_string("part %d", F.col("id") % 1000).alias("u"), F.format_string("supplier %d", (F.floor(F.col("id") / 1000) * 37 + F.col("id")) % 20).alias("v"))
    customers = spark.range(300).select(F.format_string("customer %d", "id"), F.format_string("nation %d", F.col("id") % 2))
    found = connected_components(orders.union(parts).union(customers).union(spark.createDataFrame([("alone", "alone"), (None, "alone")], "u string, v string")))
    assert {(r.component, r.n) for r in found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()} == {("customer 0", 1651), ("customer 1", 1651), ("part 0", 1020), ("alone", 1)}
    assert rows["links"][1] < rows["links"][0] / 10 and rows["links"][-1] == 0


def test_a_hubs_rows_stay_where_they_lie(spark):
    rows = spark.range(4000, numPartitions=4).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = joined_by_hub(rows, sizes, "k", "n", 100)
    assert sorted(map(tuple, found.select("k", "id", "n").collect())) == sorted(map(tuple, rows.join(sizes, "k").select("k", "id", "n").collect()))
    held = [r["count"] for r in found.filter("k = -1").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 3600 and max(held) < 1200


def test_pagerank_ranks_the_hub_first(spark):
    e = spark.createDataFrame([(f"n{i}", "hub", 1.0) for i in range(5)] + [("hub", "n0", 2.0)], "head string, tail string, weight double")
    ranks = {r.node: r["rank"] for r in graph.pagerank(e).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == "hub" and ranks["n0"] > ranks["n1"]


def test_fusion_over_names_and_pairs(spark):
    names = spark.createDataFrame([(1, "A b"), (2, "a b"), (3, "longer c name"), (4, "d")], "node int, name string")
    got = {r.node: (r.group, r.canonical) for r in graph.fused_groups(spark.createDataFrame([(2, 3)], "u int, v int"), names).collect()}
    assert got == {1: (1, "longer c name"), 2: (1, "longer c name"), 3: (1, "longer c name"), 4: (4, "d")}


def test_expansion_stops_at_its_limit(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a")], "term string, next string")
    got = {(r.term, r.round) for r in graph.expanded(spark.createDataFrame([("a",)], "term string"), links, 5, 1).collect()}
    assert got == {("a", 0), ("b", 1), ("d", 2)}


def test_ranks(spark):
    values = [3, 1, 3, 2, 9, 3]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = sorted((r.v, r.percentile) for r in percent_rank(df, "v").collect())
    assert got == sorted((v, sum(x < v for x in values) / 5) for v in values)
    assert percent_rank(df.limit(1), "v").first().percentile == 1.0
    total = {r.v: r.before for r in running_total(df.distinct().withColumn("w", F.col("v") * 10), "v", "w").collect()}
    assert total == {1: 0, 2: 10, 3: 30, 9: 60}


def test_quotas(spark):
    ratios = {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.2}
    want = sampling.quotas(ratios, 11)
    assert sum(want.values()) == 11
    rows = sampling.apportioned(spark.createDataFrame(list(ratios.items()), "name string, ratio double"), 11).collect()
    assert {r["name"]: r.quota for r in rows} == want


def test_greedy_cover(spark):
    c = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c", "d"]), (3, ["a"]), (4, ["d"])], "id int, items array<string>")
    assert [(r.id, r.gain) for r in selection.greedy_cover(c, 4).orderBy("pick").collect()] == [(2, 3), (1, 1)]
    assert [(r.id, r.gain) for r in selection.greedy_cover(c, 3, False).orderBy("pick").collect()] == [(2, 3), (1, 1), (3, 0)]


def test_distractors(spark):
    pool = spark.createDataFrame([("h", "r", x) for x in "ab"] + [("g", "r", x) for x in "bcdef"], "head string, relation string, tail string")
    asked = spark.createDataFrame([(1, "h", "r", "a"), (2, "g", "r", "c"), (3, "x", "none", "c")], "id int, head string, relation string, answer string")
    assert {r.id: list(r.distractors) for r in sampling.distractors(asked, pool).collect()} == {1: ["c", "d", "e"], 2: ["a"], 3: []}


def test_rotation_and_caps(spark):
    df = spark.createDataFrame([(i, "x" if i < 5 else f"y{i}") for i in range(8)], "id int, g string")
    assert [r.id for r in sampling.rotated(df, "g", "id", 6).collect()] == [0, 5, 6, 7, 1, 2]
    assert sampling.capped(df, "g", "id", 2).count() == 5


def test_golden_reports(spark):
    cohort = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 1), (0.65, 1), (0.4, 1), (0.5, 0), (0.3, 0), (0.2, 0), (0.1, 0)], "risk double, label int")
    row = reports.screening(cohort, "risk", "label").first()
    assert [round(x, 4) for x in row] == [0.8, 1.0, 1.0, 0.5556]
    results = spark.createDataFrame([("q", "T1", 1.0, 1.5, ""), ("q", "T3", 0.0, 0.5, "bad")], "question_type string, tier string, score double, weight double, error string")
    overall = reports.accuracy_report(results, (("tier",),)).filter("slice = ''").first()
    assert (overall.n, overall.acc, overall.weighted_acc, overall.errors) == (2, 0.5, 0.75, 1)


def test_spans(spark):
    s = spark.createDataFrame([("k", 0, 10), ("k", 2, 5), ("k", 12, 14), ("k", 20, 21)], "key string, s int, e int")
    assert {(r.s, r.e, r.n_spans) for r in turns.merged_spans(s, "key", "s", "e", 2).collect()} == {(0, 14, 3), (20, 21, 1)}
    assert {(r.s, r.e) for r in turns.outermost_spans(s, "key", "s", "e").collect()} == {(0, 10), (12, 14), (20, 21)}


def test_turns(spark):
    t = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a long answer"), (1, 2, "assistant", "a  long answer"), (1, 3, "assistant", "ok"), (1, 4, "user", "")], "c int, t int, role string, text string")
    assert [r.t for r in turns.without_repeats(t, "c", "t", "role", "text").orderBy("t").collect()] == [0, 1, 3]
    assert turns.last_assistant(t, "c", "t", "role", "text").first().turn == 3  # none says anything


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b")], "id int, k string")
    assert {r.id for r in dedup.first_per_key(df, "k", "id").collect()} == {1, 5}
    assert {r.k for r in dedup.renamed_repeats(df.filter("k <> ''"), "k", "id").collect()} == {"a", "a__d2", "b"}
    assert {r.id for r in dedup.unseen(df, df.filter("id = 1 or k = ''"), "k").collect()} == {3, 4, 5}
