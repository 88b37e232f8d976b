"""Graph operators over tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.components import connected_components, joined_by_hub, labelled
from factloom.plans.ranks import percent_rank, running_total
from factloom.functions.text import normalize_keyword
from factloom.operators.vectors import alike
from factloom.plans.storage import broadcast_if_small, drop_stored, stored


def degrees(edges: DataFrame) -> DataFrame:
    """node, in-degree, out-degree and degree."""
    ends = edges.select(F.col("head").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("tail", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def connectivity_weight(degree: Column | None) -> Column:
    """1 + ln(1 + degree); 1 for a node that isn't in the graph."""
    return F.lit(1.0) + F.log1p(F.coalesce(degree, F.lit(0)).cast("double"))


def tier(percentile: Column) -> Column:
    """T1 from 0.8, T2 from 0.2, else T3; T3_not_in_graph where there is no percentile."""
    return F.when(percentile.isNull(), "T3_not_in_graph").when(percentile >= 0.8, "T1").when(percentile >= 0.2, "T2").otherwise("T3")


def tier_weight(name: Column) -> Column:
    return F.when(name == "T1", 1.5).when(name == "T2", 1.0).otherwise(0.5)


def components(edges: DataFrame, min_size: int = 1) -> DataFrame:
    """node, component and its size, of the weakly connected components of ``min_size`` nodes or more."""
    return labelled(edges, "head", "tail").filter(F.col("size") >= min_size)


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """node and rank by weighted power iteration; parallel edges add up, and nodes without a way out give to all.

    A hub's shares are summed before the shuffle. Each round is one join with
    the edges and one sum, written to the shared folder.
    """
    flows = edges.groupBy("head", "tail").agg(F.sum("weight").alias("w"))
    out = flows.groupBy("head").agg(F.sum("w").alias("total"))
    flows = stored(flows.join(out, "head").select("head", "tail", (F.col("w") / F.col("total")).alias("share")), "flows")
    names = edges.select(F.col("head").alias("node")).union(edges.select("tail")).distinct()
    heads = flows.select(F.col("head").alias("node")).distinct().withColumn("_out", F.lit(True))
    names = stored(names.join(heads, "node", "left").select("node", F.col("_out").isNull().alias("loose")), "nodes")
    n = names.count()
    if not n:
        return names.select("node", F.lit(0.0).alias("rank"))
    ranks = stored(names.withColumns({"rank": F.lit(1.0 / n), "old": F.lit(0.0)}), "ranks")
    for _ in range(rounds):
        loose, moved = ranks.agg(F.sum(F.when(F.col("loose"), F.col("rank"))), F.sum(F.abs(F.col("rank") - F.col("old")))).first()
        if moved < n * tolerance:
            break
        given = flows.join(ranks, F.col("head") == F.col("node")).groupBy("tail").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        base = (1 - alpha) / n + alpha * (loose or 0.0) / n
        new = F.lit(base) + alpha * F.coalesce("got", F.lit(0.0))
        last, ranks = ranks, stored(ranks.join(given, F.col("node") == F.col("tail"), "left").select("node", "loose", new.alias("rank"), F.col("rank").alias("old")), "ranks")
        drop_stored(last)
    return ranks.select("node", "rank")


def pagerank_tiers(edges: DataFrame) -> DataFrame:
    """node, percentile of its log rank, tier and weight."""
    logs = stored(pagerank(edges).select("node", F.log(F.greatest("rank", F.lit(0.0)) + 1e-12).alias("log_rank")), "logs")
    found = percent_rank(logs, "log_rank").withColumn("tier", tier(F.col("percentile")))
    return found.withColumn("weight", tier_weight(F.col("tier")))


def fused_groups(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """node, group and canonical name of entities that match directly or over others.

    ``names`` has node and name, ``pairs`` u and v, nodes that match otherwise.
    Nodes of one name match without being paired: each is linked to the least
    of its name; those without a name match none. The canonical name has most
    words, then most letters.
    """
    key = normalize_keyword(F.coalesce("name", F.lit("")))
    least = names.groupBy(key.alias("k")).agg(F.min("node").alias("v"))
    same = names.withColumn("k", key).join(least, "k").select(F.col("node").alias("u"), F.when(F.col("k") != "", F.col("v")).otherwise(F.col("node")).alias("v"))
    found = stored(connected_components(pairs.select("u", "v").union(same)), "groups")
    named = found.join(names, "node")
    best = F.max_by("name", F.struct(F.size(F.split(normalize_keyword(F.col("name")), " ")), F.length("name"), F.lower("name")))
    groups = named.groupBy("component").agg(best.alias("canonical"), F.count(F.lit(1)).alias("size"))
    return joined_by_hub(named, groups, "component", "size").select("node", F.col("component").alias("group"), "canonical", "size")


def fused(nodes: DataFrame, floor: float = 0.9) -> DataFrame:
    """``fused_groups`` of ``nodes`` (node, name, type, vector): equal names, or types that agree and vectors of a cosine of ``floor`` or more.

    Also node_type, that of a group's least node with one. A null or empty type agrees with any.
    """
    links = alike(nodes.select(F.col("node").alias("id"), F.col("type").alias("kind"), "vector"), floor, links=True)
    groups = stored(fused_groups(links, nodes.select("node", "name")), "fused")
    typed = groups.join(nodes.filter("type <> ''").select("node", "type"), "node").groupBy("group").agg(F.min_by("type", F.struct("node", "type")).alias("node_type"))
    return groups.join(typed, "group", "left").select("node", "group", "canonical", "size", "node_type")


def relabelled(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``edges`` with both ends replaced by ``mapping`` (node, canonical), then parallel edges merged."""
    m = broadcast_if_small(mapping.select(F.col("node").alias("_n"), F.col("canonical").alias("_c")))
    out = edges
    for end in ("head", "tail"):
        out = out.join(m, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_c", end)).drop("_n", "_c")
    return out.groupBy("head", "tail", "normalized_relation").agg(F.sum("weight").alias("weight"), F.max("max_confidence").alias("max_confidence"))


def one_hop_evidence(edges: DataFrame, wanted: DataFrame, limit: int = 10) -> DataFrame:
    """Up to ``limit`` distinct edges of each node of ``wanted``: those that leave it first, then those that reach it."""
    cols = ("head", "normalized_relation", "tail")
    out = wanted.join(edges.select(*cols), F.col("node") == F.col("head")).select("node", F.lit(0).alias("side"), *cols)
    into = wanted.join(edges.select(*cols), F.col("node") == F.col("tail")).select("node", F.lit(1).alias("side"), *cols)
    distinct = out.union(into).groupBy("node", *cols).agg(F.min("side").alias("side"))
    by = Window.partitionBy("node").orderBy("side", *cols)
    return distinct.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


def trimmed(edges: DataFrame, limit: int) -> DataFrame:
    """Of every node's edges the ``limit`` to neighbours of highest degree; nodes left alone go."""
    deg = degrees(edges).select(F.col("node").alias("_n"), F.col("degree").alias("_d"))
    ranked = edges
    for i, (own, other) in enumerate((("head", "tail"), ("tail", "head"))):
        ranked = ranked.join(deg, F.col(other) == F.col("_n")).withColumn(f"_r{i}", F.row_number().over(Window.partitionBy(own).orderBy(F.desc("_d"), other, "normalized_relation"))).drop("_n", "_d")
    return ranked.filter((F.col("_r0") <= limit) & (F.col("_r1") <= limit)).drop("_r0", "_r1")


def ego(edges: DataFrame, limit: int = 20) -> DataFrame:
    """The node of highest degree with its ``limit`` neighbours of highest degree."""
    deg = stored(degrees(edges), "degrees")
    hub = deg.orderBy(F.desc("degree"), "node").limit(1).select(F.col("node").alias("hub"))
    near = edges.join(F.broadcast(hub), F.col("head") == F.col("hub")).select("hub", F.col("tail").alias("node"))
    near = near.union(edges.join(F.broadcast(hub), F.col("tail") == F.col("hub")).select("hub", F.col("head").alias("node"))).distinct()
    return near.join(deg, "node").orderBy(F.desc("degree"), "node").limit(limit)


def expanded(seeds: DataFrame, links: DataFrame, rounds: int, limit: int | None = None) -> DataFrame:
    """term, round and parent reached from ``seeds`` (term) over ``links`` (term, next); of a round's new terms the first ``limit``, if there is one."""
    seen = stored(seeds.select("term").distinct().withColumns({"round": F.lit(0), "parent": F.lit(None).cast("string")}), "seen")
    frontier = seen
    for i in range(1, rounds + 1):
        reached = frontier.select("term").join(links, "term").select(F.col("next").alias("term"), F.col("term").alias("parent"))
        new = reached.groupBy("term").agg(F.min("parent").alias("parent")).join(seen.select("term"), "term", "left_anti")
        new = new if limit is None else new.orderBy("term").limit(limit)
        frontier = stored(new.select("term", F.lit(i).alias("round"), "parent"), "frontier")
        if not frontier.limit(1).count():
            break
        seen = stored(seen.union(frontier), "seen")
    return seen


def expanded_with_notes(seeds: DataFrame, links: DataFrame, rounds: int, cap: int, min_length: int = 0) -> DataFrame:
    """term, parent, round, place, accepted and note of every term that is met on the way from ``seeds`` (term) over ``links`` (term, next).

    Terms are met in order: seeds by name, then round by round the links of
    the terms that the round before accepted, in their order and by name. The
    note says why a term isn't taken up, all reasons in turn: min_length,
    duplicate (accepted before, whether in an earlier round or in this), and
    max_terms, once ``cap`` terms were met, whatever became of these. Each
    round is written once; accepted and rejected terms are all there is.
    """
    spark = seeds.sparkSession
    kind = "term string, parent string, round int, place bigint, accepted boolean, note string"
    first = running_total(seeds.select("term").dropna().distinct().withColumn("_one", F.lit(1)), "term", "_one", "place")
    met = [stored(first.select("term", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("round"), F.col("place").cast("bigint").alias("place"), F.lit(True).alias("accepted"), F.lit("").alias("note")), "round")]
    n = met[0].count()
    links = links.select("term", "next").dropna()
    for i in range(1, rounds + 1):
        known = met[0].filter("accepted").select("term")
        for m in met[1:]:
            known = known.union(m.filter("accepted").select("term"))
        at = met[-1].filter("accepted").select("term", F.col("place").alias("_from"))
        # repeated links go once they are those of the frontier, which seldom are many
        own = links.join(broadcast_if_small(at), "term").distinct()
        found = own.select(F.col("next").alias("term"), F.col("term").alias("parent"), F.struct("_from", "next").alias("_order"), F.lit(1).alias("_one"))
        numbered = stored(running_total(found, "_order", "_one", "_n").select("term", "parent", (F.lit(n) + F.col("_n")).cast("bigint").alias("place")), "met")
        size = numbered.count()
        if not size:
            break
        before = numbered.join(known.withColumn("_before", F.lit(True)), "term", "left").withColumn("_before", F.coalesce("_before", F.lit(False)))
        # the first of equal terms is taken up if anything is; others are duplicates if it was
        taken = numbered.groupBy("term").agg(F.min("place").alias("_least")).filter(F.col("_least") < cap)
        both = before.join(taken, "term", "left")
        short, over = F.length("term") < min_length, F.col("place") >= cap
        again = F.col("_before") | (~short & F.coalesce(F.col("_least") < F.col("place"), F.lit(False)))
        note = F.concat_ws("; ", F.when(short, "min_length"), F.when(again, "duplicate"), F.when(over, "max_terms"))
        met.append(stored(both.select("term", "parent", F.lit(i).alias("round"), "place", (note == "").alias("accepted"), note.alias("note")), "round"))
        drop_stored(numbered)
        n += size
    out = spark.createDataFrame([], kind)
    for m in met:
        out = out.unionByName(m)
    return out
