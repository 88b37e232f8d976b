"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import broadcast_if_small, drop_stored, stored

#: Rows of one key from which on its value is broadcast.
HUB = 100_000


def joined_by_hub(rows: DataFrame, values: DataFrame, key: str, size: str, hub: int = HUB) -> DataFrame:
    """``rows`` with the one row of ``values`` that has their ``key``, where ``size`` says how many of ``rows`` have it; without a match a row is left out.

    Keys of more than ``hub`` rows are sent to the rows where these lie, one
    row for each, so that no task has to sort all that a key has. There are
    fewer of them than rows divided by ``hub``.
    """
    hubs = F.broadcast(values.filter(F.col(size) > hub))
    others = rows.join(hubs.select(key), key, "left_anti").join(values.filter(F.col(size) <= hub), key)
    return others.union(rows.join(hubs, key))


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``pairs`` with its ends as numbers, and the number of each node where these are others than the nodes themselves.

    Numbers are hashes, by a seed for which no two nodes share one.
    """
    if {t for _, t in pairs.dtypes} <= {"tinyint", "smallint", "int", "bigint"}:
        return stored(pairs.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")), "links"), None
    pairs = stored(pairs, "edges")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    for seed in range(64):
        number = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        nodes = stored(ends.select(number("node").alias("id"), "node"), "nodes")
        if nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
        ends = nodes.select("node")
    links = stored(pairs.select(number("u").alias("u"), number("v").alias("v")), "links")
    drop_stored(pairs)
    return links, nodes


def _moved(links: DataFrame, level: DataFrame, end: str, hub: int, hubs: DataFrame | None) -> DataFrame:
    """``links`` with ``end`` replaced by what ``level`` (id, to, n) has for it; the rows of ``hubs``, with more than ``hub``, are dealt into parts."""
    other = "v" if end == "u" else "u"
    if hubs is None:
        return links.join(level.select("id", "to"), F.col(end) == F.col("id")).select(F.col("to").alias(end), other)
    # there are fewer of them than rows divided by ``hub``
    dealt = links.join(F.broadcast(hubs), F.col(end) == F.col("id"), "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64(other), "parts"), F.lit(0)).alias("part"))
    parts = F.when(F.col("n") > hub, F.floor(F.col("n") / hub)).otherwise(F.lit(0))
    wide = level.select("id", "to", F.explode(F.sequence(F.lit(0).cast("bigint"), parts)).alias("_part"))
    return dealt.join(wide, (F.col(end) == F.col("id")) & (F.col("part") == F.col("_part"))).select(F.col("to").alias(end), other)


def labelled(edges: DataFrame, u: str = "u", v: str = "v", hub: int = HUB) -> DataFrame:
    """(node, component, size) for each node of ``edges``, as ``connected_components`` names them."""
    links, nodes = _numbered(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).dropna())
    levels = []
    while True:
        # each node goes to its least neighbour, which takes a star to its centre, and in every other round
        # to the least of itself and its neighbours, which ends pairs, in an order of the round's own
        order = lambda c: F.xxhash64(c, F.lit(len(levels)))  # noqa: B023, E731
        ways = [F.struct(F.col(a).alias("id"), F.col(b).alias("other")) for a, b in (("u", "v"), ("v", "u"))]
        ends = links.select(F.inline(F.array(*ways)))
        ends = ends.withColumn("least", F.when((order("other") < order("id")) if len(levels) % 2 else (F.col("other") != F.col("id")), order("other")))
        level = ends.groupBy("id").agg(F.min_by("other", "least").alias("to"), F.count(F.lit(1)).alias("n"))
        level = stored(level.select("id", F.coalesce("to", "id").alias("to"), "n"), "level")
        levels.append(level)
        hubs = level.filter(F.col("n") > hub).select("id", (F.floor(F.col("n") / hub) + 1).alias("parts"))
        hubs = None if hubs.isEmpty() else hubs
        left = stored(_moved(_moved(links, level, "u", hub, hubs), level, "v", hub, hubs).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        drop_stored(links)
        links = left
        if links.isEmpty():
            break
    found = levels[-1].select("id", F.col("to").alias("label"))
    for level in reversed(levels[:-1]):
        after = broadcast_if_small(found.withColumnRenamed("id", "_id"))
        found = stored(level.join(after, F.col("to") == F.col("_id"), "left").select("id", F.coalesce("label", "to").alias("label")), "found")
    found = found.withColumnRenamed("id", "node") if nodes is None else found.join(nodes, "id").select("node", "label")
    found = stored(found, "labels")
    names = stored(found.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")), "names")
    return joined_by_hub(found, names, "label", "size", hub).select("node", "component", "size")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", hub: int = HUB) -> DataFrame:
    """(node, component) for each node of ``edges``; a component is named by its least node.

    Contracts the graph round by round: each node goes to its least neighbour
    in the round's own random order, and links join what their ends have gone
    to, until none is left. Most nodes and links are gone
    after a round, and what a node went to is followed from the last round
    to the first. Every round is written to the shared folder; rounds grow
    with the logarithm of the nodes. Nodes are numbers on the way. Links from
    a node to itself keep it as a component of its own; null ends are dropped;
    no edges give no rows.
    """
    return labelled(edges, u, v, hub).select("node", "component")
