"""Sampling plans over orders and their suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import graph, sampling, selection, sessions
from factloom.plans.storage import parts_for, stored

from .base import facts, query, table


def _samples(spark, d):
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return line.join(orders, line.l_orderkey == orders.o_orderkey)


@query()
def node_allocation(spark, d):
    """Orders as samples, by priority, for suppliers as nodes, which have quotas by tier; choices in rounds, so without SQL."""
    suppliers = table(spark, d, "supplier")
    tier = F.when(F.col("s_suppkey") % 10 == 0, "T1").when(F.col("s_suppkey") % 3 == 0, "T2").otherwise("T3")
    nodes = suppliers.select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("node"), tier.alias("tier"))
    quotas = stored(sampling.node_quotas(nodes, suppliers.count()), "quotas")
    kinds = [r["p"] for r in table(spark, d, "orders").select(F.col("o_orderpriority").alias("p")).distinct().orderBy("p").collect()]  # a row for each priority
    targets = selection.type_targets(sampling_ratios(kinds), suppliers.count())
    touched = _samples(spark, d).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("node"))
    return selection.allocated_by_node(touched, quotas, targets)


def sampling_ratios(kinds: list[str]) -> dict[str, float]:
    """The first kind is wanted twice as often as each other one."""
    return {k: (2 if i == 0 else 1) / (len(kinds) + 1) for i, k in enumerate(kinds)}


@query()
def balanced_subset(spark, d):
    """Orders that cover most kinds of parts, three of each priority and status first; choices in sequence, so without SQL."""
    return selection.balanced_subset(_kinds_of_parts(spark, d), 3, 150)


def _kinds_of_parts(spark, d):
    """A row for each line: the order as id, its stratum, and the kind of part as items; dealt out by id, no partition with more than its share of a larger table."""
    line, orders, part = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    n = parts_for(spark, line.count())
    part = part.select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("item")).repartition(n, "p_partkey")
    orders = orders.select("o_orderkey", F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("stratum")).repartition(n, "o_orderkey")
    lines = line.select("l_orderkey", "l_partkey").repartition(n, "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "item")
    return lines.repartition(n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), "stratum", F.array("item").alias("items"))


@query()
def frontier_notes(spark, d):
    """What is met within three steps of the regions, with the reason for all that isn't taken up; order decides, so without SQL."""
    edges = facts(spark, d)
    seeds = edges.filter("normalized_relation = 'part_of'").select(F.col("tail").alias("term"))
    return graph.expanded_with_notes(seeds, edges.select(F.col("tail").alias("term"), F.col("head").alias("next")), 3, 20_000, 8)


@query(
    """WITH r AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) b FROM events),
    s AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) n FROM r WHERE b IS NULL OR b <> event_type)
    SELECT user_id, event_type, epoch_us(ts) since FROM s WHERE epoch_us(coalesce(n, (SELECT max(ts) FROM events))) - epoch_us(ts) > 43200000000"""
)
def signature_stalls(spark, d):
    """Users whose kind of event stays the same for over twelve hours."""
    found = sessions.signature_stalls(table(spark, d, "events"), "user_id", "ts", "event_type", 12 * 3600)
    return found.select("user_id", "event_type", F.unix_micros("since").alias("since"))


@query(
    """WITH RECURSIVE p AS (SELECT DISTINCT user_id s, user_id // 2 a, user_id * 7919 % (SELECT count(*) FROM events) c FROM events WHERE user_id > 0),
    w AS (SELECT s, a, c FROM p UNION ALL SELECT w.s, p.a, least(w.c, p.c) FROM w JOIN p ON p.s = w.a),
    v AS (SELECT w.s viewer, event_id FROM w JOIN events ON user_id = a AND event_id < c UNION ALL SELECT user_id, event_id FROM events)
    SELECT viewer, count(*) n, max(event_id) latest, CAST(sum(event_id) AS BIGINT) total FROM v GROUP BY viewer"""
)
def session_lineage(spark, d):
    """What every user's log holds when it goes back to that of the user with half its number, and so on."""
    events = table(spark, d, "events").select("user_id", "event_id")
    n = events.count()
    resets = events.select(F.col("user_id").alias("session"), F.expr("user_id div 2").alias("parent"), (F.col("user_id") * 7919 % n).alias("cutoff")).filter("session > 0").distinct()
    seen = sessions.visible(events, resets, "user_id", "event_id")
    return seen.groupBy("viewer").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("latest"), F.sum("event_id").alias("total"))
