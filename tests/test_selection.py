"""Sampling plans against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import sampling, selection


def draw(*names):
    return hashlib.sha1("|".join(map(str, names)).encode()).hexdigest()


def allocated(samples, nodes, targets, seed=7):
    """The same rounds in dictionaries."""
    left, want, have, out, n = dict(samples), {k: q for k, (_, q) in nodes.items() if q > 0}, {}, [], 0
    for tier in ("T1", "T2", "T3"):
        while True:
            behind = lambda t: targets.get(t, 0) - have.get(t, 0)
            wishes = {}
            for node in [k for k in want if nodes[k][0] == tier]:
                pools = {}
                for i, (t, at) in left.items():
                    if node in at:
                        pools.setdefault(t, []).append(i)
                if pools:
                    t = min(pools, key=lambda t: (-behind(t), -len(pools[t]), t))
                    wishes.setdefault((t, min(pools[t], key=lambda i: (draw(seed, i), i))), []).append(node)
            if not wishes:
                break
            n += 1
            won = {}
            for (t, i), asking in wishes.items():
                won.setdefault(t, []).append((*min((draw(seed, k), k) for k in asking), i))
            most = {t: max(behind(t), -(-len(w) // 2)) for t, w in won.items()}
            for t, w in won.items():
                for _, node, i in sorted(w)[: most[t]]:
                    out.append((i, t, node, tier, n))
                    del left[i]
                    want[node] -= 1
                    want = {k: q for k, q in want.items() if q}
                    have[t] = have.get(t, 0) + 1
    return sorted(out)


def test_allocation_equals_a_plain_loop(spark):
    seed = 1
    d = random.Random(seed)
    nodes = {f"n{i:02}": (d.choice(["T1", "T2", "T3"]), d.randrange(4)) for i in range(25)}
    samples = {i: (d.choice("aabc"), d.sample(sorted(nodes), d.randrange(1, 4))) for i in range(90)}
    targets = selection.type_targets({"a": 0.2, "b": 0.5, "c": 0.3}, 40)
    touched = spark.createDataFrame([(i, t, k) for i, (t, at) in samples.items() for k in at] * 2 + [(None, "a", "n00"), (1000, "a", None)], "id long, type string, node string")
    table = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node string, tier string, quota long")
    picked = selection.allocated_by_node(touched, table, targets, seed)
    got = sorted(map(tuple, picked.collect()))
    assert got == allocated(samples, nodes, targets, seed) and len({r[0] for r in got}) == len(got)
    gaps = {r.tier: (r.nodes, r.wanted, r.got, r.short) for r in selection.quota_gaps(picked, table).collect()}
    assert sum(g[2] for g in gaps.values()) == len(got) and all(g[2] <= g[1] for g in gaps.values())


def test_quotas_and_ratios_are_met_where_samples_abound(spark):
    """Every node touches many samples of each type: quotas are filled, and types end at their targets."""
    nodes = spark.createDataFrame([(f"n{i}", ["T1", "T2", "T3"][i % 3]) for i in range(30)], "node string, tier string")
    quotas = sampling.node_quotas(nodes, 50)
    touched = spark.range(3000).select("id", F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("type"), F.concat(F.lit("n"), (F.col("id") / 3 % 30).cast("int").cast("string")).alias("node"))
    picked = selection.allocated_by_node(touched, quotas, selection.type_targets({"a": 0.6, "b": 0.2, "c": 0.2}, 50))
    assert {r.type: r["count"] for r in picked.groupBy("type").count().collect()} == {"a": 30, "b": 10, "c": 10}
    assert selection.quota_gaps(picked, quotas).filter("short > 0").count() == 0


def test_allocation_of_nothing(spark):
    none = spark.createDataFrame([], "id long, type string, node string")
    nodes = spark.createDataFrame([("n", "T1", 2)], "node string, tier string, quota long")
    assert selection.allocated_by_node(none, nodes, {}).count() == 0
    assert selection.quota_gaps(selection.allocated_by_node(none, nodes, {}), nodes).first().short == 1


def naive(rows, cap, budget):
    """The best of all, counted again for every pick."""
    chosen, covered, out = [], set(), []

    def best(ids, least):
        gains = [(-len(rows[i][1] - covered), i) for i in ids if i not in chosen]
        return min(gains) if gains and -min(gains)[0] >= least else None

    def take(found, phase):
        chosen.append(found[1])
        covered.update(rows[found[1]][1])
        out.append((len(chosen), found[1], phase, -found[0]))

    for s in sorted({r[0] for r in rows.values()}):
        own = [i for i, r in rows.items() if r[0] == s]
        for _ in range(cap):
            if found := best(own, 0):
                take(found, 1)
    while len(chosen) < budget and (found := best(rows, 1)):
        take(found, 2)
    return out


@pytest.mark.parametrize(("pulled", "cap", "budget"), [(50_000, 4, 20), (12, 2, 30)])
def test_subset_equals_a_naive_loop(spark, pulled, cap, budget, monkeypatch):
    monkeypatch.setattr(selection, "PULLED", pulled)
    d = random.Random(5)
    rows = {i: (d.choice("xyz"), {d.randrange(60) for _ in range(d.choice([0, 1, 2, 4, 9]))}) for i in range(70)}
    table = spark.createDataFrame([(i, s, [*map(str, v), None]) for i, (s, v) in rows.items()], "id long, stratum string, items array<string>")
    text = {i: (s, set(map(str, v))) for i, (s, v) in rows.items()}
    assert sorted(map(tuple, selection.balanced_subset(table, cap, budget).collect())) == naive(text, cap, budget)


def test_rounds_are_fewer_than_picks(spark):
    d = random.Random(6)
    table = spark.createDataFrame([(i, "s", [str(d.randrange(2000)) for _ in range(6)]) for i in range(600)], "id long, stratum string, items array<string>")
    greedy = selection._Greedy(table)
    while len(greedy.chosen) < 100:
        greedy.take(greedy.step(F.lit(True), 100 - len(greedy.chosen)))
    assert len(greedy.chosen) == 100 and greedy.rounds <= 5


def test_subset_of_nothing(spark):
    assert selection.balanced_subset(spark.createDataFrame([], "id long, stratum string, items array<string>"), 3, 5).count() == 0


def test_links_are_told_apart_behind_the_frontier(spark, monkeypatch):
    """A round gathers the links of its own frontier alone; repeated links count once."""
    from factloom.operators import graph

    plans, total = [], graph.running_total
    monkeypatch.setattr(graph, "running_total", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or total(df, *a))
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("c", "a"), ("x", "y")], "term string, next string")
    got = graph.expanded_with_notes(spark.createDataFrame([("a",)], "term string"), links, 2, 100).select("term", "parent", "round", "note").collect()
    assert sorted(map(tuple, got), key=str) == [("a", "c", 2, "duplicate"), ("a", None, 0, ""), ("b", "a", 1, ""), ("c", "a", 1, "")]
    assert len(plans) == 3 and all(p.count("Aggregate") == 1 and p.index("Aggregate") < p.index("Join") for p in plans[1:])


def test_lines_of_a_larger_table_are_dealt_into_more_parts(spark, monkeypatch):
    """No order's kinds are collected, and a part holds its share of lines whatever the size; repeated rows of an id count once."""
    from factloom.plans import storage
    from factloom.queries import picks

    monkeypatch.setattr(picks, "parts_for", lambda s, rows: storage.parts_for(s, rows, 500))
    rows = picks._kinds_of_parts(spark, "/root/testdata/sf0.001")
    assert storage.parts_for(spark, 3) == 4 and storage.parts_for(spark, 5_000_001) == 11
    assert rows.rdd.getNumPartitions() == -(-rows.count() // 500) > 4
    assert "collect_set" not in rows._jdf.queryExecution().optimizedPlan().toString()
    table = spark.createDataFrame([(1, "s", ["a"]), (1, "s", ["b"]), (1, "s", ["a"]), (2, "s", ["c"])], "id long, stratum string, items array<string>")
    assert sorted(map(tuple, selection.balanced_subset(table, 1, 3).collect())) == [(1, 1, 1, 2), (2, 2, 2, 1)]
