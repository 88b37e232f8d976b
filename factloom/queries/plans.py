"""Sampling plans and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import judging, sampling

from .base import query, table

_TIERS = "nodes AS (SELECT 'part ' || p_partkey node, CASE WHEN p_size >= 40 THEN 'T1' WHEN p_size >= 20 THEN 'T2' ELSE 'T3' END tier FROM part)"


@query(
    f"""WITH {_TIERS}, c AS (SELECT count(*) FILTER (tier = 'T1') n1, count(*) FILTER (tier = 'T2') n2, count(*) FILTER (tier = 'T3') n3, count(*) // 2 total FROM nodes), e AS (SELECT *, greatest(0, 3 * n1 + 2 * n2 + n3 - total) x FROM c),
    g AS (SELECT *, least(x, n3) g3, least(x - least(x, n3), 2 * n2) g2, x - least(x, n3) - least(x - least(x, n3), 2 * n2) g1 FROM e),
    r AS (SELECT node, tier, row_number() OVER (PARTITION BY tier ORDER BY sha1('7|' || node), node) r FROM nodes)
    SELECT node, tier, CAST(CASE tier WHEN 'T1' THEN 3 - g1 // n1 - CASE WHEN r <= g1 % n1 THEN 1 ELSE 0 END WHEN 'T2' THEN 2 - g2 // n2 - CASE WHEN r <= g2 % n2 THEN 1 ELSE 0 END ELSE 1 - g3 // n3 - CASE WHEN r <= g3 % n3 THEN 1 ELSE 0 END END AS BIGINT) quota FROM r, g"""
)
def node_quota(spark, d):
    """How many samples each part should have, half as many together as there are parts."""
    part = table(spark, d, "part")
    tier = F.when(F.col("p_size") >= 40, "T1").when(F.col("p_size") >= 20, "T2").otherwise("T3")
    nodes = part.select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("node"), tier.alias("tier"))
    return sampling.node_quotas(nodes, part.count() // 2)


@query(
    """WITH s AS (SELECT o_orderkey id, o_orderpriority AS type FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT type, count(*) n FROM s GROUP BY 1), t AS (SELECT sum(n) total, count(*) types FROM n),
    c AS (SELECT type, count(DISTINCT l_partkey) covered FROM s JOIN lineitem ON l_orderkey = id GROUP BY 1)
    SELECT type, n, round(n / total, 4) AS share, round(n / total - 1.0 / types, 4) deviation, coalesce(covered, 0) covered_nodes, round(coalesce(covered, 0) / (SELECT count(*) FROM part), 4) coverage FROM n LEFT JOIN c USING (type), t"""
)
def allocation_report(spark, d):
    """Every second order as a sample: how its kinds share them, and the parts that they touch."""
    chosen = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"))
    touched = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("node"))
    return sampling.allocation_report(chosen, touched, table(spark, d, "part").count())


_NEEDLES = ("an", "er", "token", "license", "Secret", "ou")
_HITS = " + ".join(f"CASE WHEN contains(lower(text), '{n.lower()}') THEN 1 ELSE 0 END" for n in _NEEDLES)


@query(f"""WITH s AS (SELECT doc_id, source, CAST({_HITS} AS INTEGER) hits FROM documents) SELECT doc_id, source, hits, CAST(place AS INTEGER) place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) place FROM s WHERE hits > 0) WHERE place <= 5""")
def needle_selection(spark, d):
    """Of each source the five texts that hold most of some words."""
    return sampling.top_by_needles(table(spark, d, "documents"), "source", "text", "doc_id", list(_NEEDLES), 5).select("doc_id", "source", "hits", "place")


@query("""SELECT conv_id, count(*) n_judgments, count(*) FILTER (role = 'user') n_hallucination, count(*) FILTER (turn % 3 = 0) n_verification_error FROM conversations GROUP BY 1""")
def judgment_summary(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.when(F.col("role") == "user", " YES").otherwise("no").alias("hallucination"), F.when(F.col("turn") % 3 == 0, "Yes").alias("verification_error"))
    return judging.summary(rows, "conv_id")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, CASE WHEN turn % 4 = 0 THEN NULL ELSE turn END NULLS LAST, md5(text)) place FROM conversations""")
def concept_ranks(spark, d):
    at = F.when(F.col("turn") % 4 != 0, F.col("turn"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("wrong"), at.alias("at"), F.md5("text").alias("concept"))
    return judging.ranked(rows, "conv_id", "wrong", "at").select("conv_id", "turn", F.col("place").cast("long").alias("place"))
