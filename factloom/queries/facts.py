"""Triples, edges, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import graph, sampling, triples
from factloom.plans.ranks import percent_rank
from factloom.plans.storage import stored

from .base import FACTS, facts, query

_SUPPORT = """
supported AS (
  SELECT head, relation, tail, count(DISTINCT (doc_id, chunk_id)) support_count, count(DISTINCT doc_id) doc_count, avg(confidence) avg_confidence
  FROM facts GROUP BY head, relation, tail
)"""


@query(
    f"""WITH {FACTS}, {_SUPPORT}
    SELECT head, relation AS normalized_relation, tail, support_count, doc_count, round(avg_confidence, 6) avg_confidence,
      CASE WHEN relation IN ('part_of', 'associated_with') THEN 'weak' ELSE 'medium' END strength
    FROM supported WHERE support_count >= 2 AND avg_confidence >= 0.3"""
)
def one_hop_eligible(spark, d):
    """Which facts have enough sources and confidence to ask about."""
    found = triples.support(facts(spark, d), "head", "normalized_relation", "tail")
    found = found.filter((F.col("support_count") >= 2) & (F.col("avg_confidence") >= 0.3))
    return found.select("head", "normalized_relation", "tail", "support_count", "doc_count", F.round("avg_confidence", 6).alias("avg_confidence"), T.relation_strength("normalized_relation").alias("strength"))


@query(
    f"""WITH {FACTS} SELECT CASE WHEN relation = 'part_of' THEN 'weak' ELSE 'medium' END strength, count(*) n_rows, count(DISTINCT (head, relation, tail)) n_edges FROM facts GROUP BY 1"""
)
def hop_strength(spark, d):
    rows = facts(spark, d).withColumn("strength", T.relation_strength("normalized_relation"))
    return rows.groupBy("strength").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("head", "normalized_relation", "tail").alias("n_edges"))


_EDGES = "edges AS (SELECT DISTINCT head, relation, tail FROM facts WHERE relation <> 'supplies')"


def _edges(spark, d):
    return facts(spark, d).filter("normalized_relation <> 'supplies'").select("head", "normalized_relation", "tail").distinct()


@query(
    f"""WITH {FACTS}, {_EDGES} SELECT a.head, a.relation AS first, a.tail AS "pivot", b.relation AS second, b.tail FROM edges a JOIN edges b ON a.tail = b.head WHERE b.tail <> a.head"""
)
def two_hop_paths(spark, d):
    return triples.two_hops(_edges(spark, d))


@query(
    f"""WITH {FACTS}, {_EDGES} SELECT a.relation AS first, b.relation AS second, c.relation AS third, count(*) n FROM edges a JOIN edges b ON a.tail = b.head JOIN edges c ON b.tail = c.head
    WHERE b.tail <> a.head AND c.tail NOT IN (a.head, a.tail) GROUP BY ALL"""
)
def three_hop_count(spark, d):
    return triples.three_hops(_edges(spark, d)).groupBy("first", "second", "third").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH paths AS (SELECT DISTINCT 'supplier ' || l_suppkey head, 'part ' || l_partkey AS "pivot", p_brand || '/' || p_size tail FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT head, 'supplies' AS first, 'branded' AS second, tail, min("pivot") AS "pivot" FROM paths GROUP BY head, tail HAVING count(DISTINCT "pivot") = 1"""
)
def pivot_unique(spark, d):
    """Brands and sizes that a supplier supplies by just one part."""
    supplies = facts(spark, d).filter("normalized_relation = 'supplies'").select("head", "normalized_relation", "tail").distinct()
    branded = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("head"), F.lit("branded").alias("normalized_relation"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("tail"))
    return triples.sole_pivots(triples.two_hops(supplies.union(branded)))


@query(
    f"""WITH {FACTS} SELECT doc_id, head, tail, relation AS normalized_relation, round(sum(confidence), 6) weight, max(confidence) max_confidence, count(*) n_evidence, string_agg(DISTINCT source, ',' ORDER BY source) sources
    FROM facts GROUP BY doc_id, head, tail, relation"""
)
def edge_local(spark, d):
    return triples.local_edges(facts(spark, d)).select("doc_id", "head", "tail", "normalized_relation", F.round("weight", 6).alias("weight"), "max_confidence", F.size("evidence").cast("long").alias("n_evidence"), F.array_join("sources", ",").alias("sources"))


_LOCAL = """local AS (SELECT doc_id, head, tail, relation, sum(confidence) weight, max(confidence) max_confidence FROM facts GROUP BY doc_id, head, tail, relation)"""


@query(
    f"""WITH {FACTS}, {_LOCAL}, docs AS (SELECT doc_id, min(seq) doc_order FROM facts GROUP BY doc_id)
    SELECT head, tail, relation AS normalized_relation, round(arg_max(weight, doc_order), 6) weight, arg_max(max_confidence, doc_order) max_confidence, arg_max(doc_id, doc_order) doc_id
    FROM local JOIN docs USING (doc_id) GROUP BY head, tail, relation"""
)
def edge_global_last_doc(spark, d):
    rows = facts(spark, d)
    found = triples.global_edges(triples.local_edges(rows), order=triples.document_order(rows))
    return found.select("head", "tail", "normalized_relation", F.round("weight", 6).alias("weight"), "max_confidence", "doc_id")


@query(
    f"""WITH {FACTS}, {_LOCAL} SELECT head, tail, relation AS normalized_relation, round(sum(weight), 6) weight, max(max_confidence) max_confidence, count(*) n_docs FROM local GROUP BY head, tail, relation"""
)
def edge_global_sum(spark, d):
    found = triples.global_edges(triples.local_edges(facts(spark, d)), "sum")
    return found.select("head", "tail", "normalized_relation", F.round("weight", 6).alias("weight"), "max_confidence", "n_docs")


@query(
    f"""WITH {FACTS}, ends AS (SELECT head node, head_type node_type, source, seq FROM facts UNION ALL SELECT tail, tail_type, source, seq FROM facts)
    SELECT node, arg_min(node_type, seq) node_type, string_agg(DISTINCT source, ',' ORDER BY source) sources, count(*) mentions FROM ends GROUP BY node"""
)
def graph_nodes(spark, d):
    return triples.nodes(facts(spark, d)).select("node", "node_type", F.array_join("sources", ",").alias("sources"), "mentions")


def _brands(spark, d):
    """Triples with repeats: a line's brand and flag as the relation's wording."""
    line, part = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "part"))
    rows = line.join(part, line.l_partkey == part.p_partkey)
    return rows.select(
        F.col("l_suppkey").cast("string").alias("doc_id"), F.col("l_orderkey").cast("string").alias("chunk_id"), F.col("p_brand").alias("head"), F.lit("Brand").alias("head_type"),
        F.col("l_returnflag").alias("surface_relation"), F.lit("sold_in").alias("normalized_relation"), F.col("p_type").alias("tail"), F.lit("Kind").alias("tail_type"),
        F.round(F.col("l_quantity") / 50, 2).alias("confidence"), F.col("p_name").alias("evidence"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"),
    )


_BRANDS = """rows AS (SELECT CAST(l_suppkey AS VARCHAR) doc_id, CAST(l_orderkey AS VARCHAR) chunk_id, p_brand head, p_type tail, l_returnflag surface_relation,
  round(l_quantity / 50, 2) confidence, p_name evidence, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey seq FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    f"""WITH {_BRANDS}, best AS (SELECT doc_id, head, tail, max(confidence) confidence, arg_min(chunk_id, seq) chunk_id, min(seq) seq FROM rows GROUP BY doc_id, head, tail),
    top AS (SELECT r.doc_id, r.head, r.tail, min(r.seq) top_seq FROM rows r JOIN best b ON r.doc_id = b.doc_id AND r.head = b.head AND r.tail = b.tail AND r.confidence = b.confidence GROUP BY 1, 2, 3)
    SELECT b.doc_id, b.head, b.tail, b.confidence, b.chunk_id, b.seq, arg_min(r.surface_relation, r.seq) surface_relation, arg_max(r.evidence, length(r.evidence) * 1000000000000000 - r.seq) evidence
    FROM best b JOIN top t ON b.doc_id = t.doc_id AND b.head = t.head AND b.tail = t.tail JOIN rows r ON r.doc_id = b.doc_id AND r.head = b.head AND r.tail = b.tail AND r.seq >= t.top_seq
    GROUP BY b.doc_id, b.head, b.tail, b.confidence, b.chunk_id, b.seq"""
)
def triple_dedup(spark, d):
    return triples.deduplicated(_brands(spark, d)).select("doc_id", "head", "tail", "confidence", "chunk_id", "seq", "surface_relation", "evidence")


@query(
    f"""WITH {_BRANDS} SELECT coalesce(reason, 'kept') drop_reason, count(*) n FROM (SELECT CASE WHEN lower(head) = 'brand#7' THEN 'generic'
      WHEN tail NOT IN ('ECONOMY', 'PROMO', 'STANDARD', 'LARGE', 'SMALL', 'MEDIUM') THEN NULL END reason FROM rows WHERE confidence > 0.5) GROUP BY 1"""
)
def normalize_drop_reasons(spark, d):
    rows = triples.normalized(_brands(spark, d), generic=("brand#7",))
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {FACTS} SELECT node, count(*) degree, round(1 + ln(1 + count(*)), 6) weight FROM (SELECT head node FROM facts UNION ALL SELECT tail FROM facts) GROUP BY node"""
)
def degree_weight(spark, d):
    found = graph.degrees(facts(spark, d))
    return found.select("node", "degree", F.round(graph.connectivity_weight(F.col("degree")), 6).alias("weight"))


@query(
    """WITH n AS (SELECT l_partkey part, count(*) degree FROM lineitem GROUP BY 1), p AS (SELECT part, degree, percent_rank() OVER (ORDER BY degree) percentile FROM n)
    SELECT part, degree, round(percentile, 6) percentile, CASE WHEN percentile >= 0.8 THEN 'T1' WHEN percentile >= 0.2 THEN 'T2' ELSE 'T3' END tier,
    CASE WHEN percentile >= 0.8 THEN 1.5 WHEN percentile >= 0.2 THEN 1.0 ELSE 0.5 END weight FROM p"""
)
def percentile_tier(spark, d):
    n = stored(spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("degree")), "degrees")
    tier = graph.tier(F.col("percentile"))
    return percent_rank(n, "degree").select("part", "degree", F.round("percentile", 6).alias("percentile"), tier.alias("tier"), graph.tier_weight(tier).alias("weight"))


@query(
    """WITH RECURSIVE home AS (SELECT s_suppkey s, n_regionkey r FROM supplier JOIN nation ON s_nationkey = n_nationkey), part_of AS (SELECT DISTINCT l_partkey p, r FROM lineitem JOIN home ON l_suppkey = s),
    near AS (SELECT DISTINCT a.r a, b.r b FROM part_of a JOIN part_of b USING (p)), reach AS (SELECT DISTINCT n_regionkey a, n_regionkey b FROM nation UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
    root AS (SELECT a r, min(b) c FROM reach GROUP BY a),
    ends AS (SELECT n_regionkey r, 'region ' || n_regionkey node FROM nation UNION SELECT n_regionkey, 'nation ' || n_nationkey FROM nation UNION SELECT r, 'part ' || p FROM part_of
      UNION SELECT n_regionkey, 'customer ' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT r, 'supplier ' || s FROM home
      UNION SELECT n_regionkey, 'order ' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    named AS (SELECT DISTINCT node, c FROM ends JOIN root USING (r)) SELECT node, min(node) OVER (PARTITION BY c) component, count(*) OVER (PARTITION BY c) size FROM named"""
)
def weak_components(spark, d):
    """Regions that suppliers of one part join, with all that is in them."""
    return graph.components(facts(spark, d).select("head", "tail"), 2)


@query(
    f"""WITH {FACTS}, e AS (SELECT 'nation ' || n_nationkey node FROM nation), hits AS (
      SELECT node, head, relation, tail, min(side) side FROM (SELECT e.node, f.head, f.relation, f.tail, 0 side FROM e JOIN facts f ON f.head = e.node UNION ALL SELECT e.node, f.head, f.relation, f.tail, 1 FROM e JOIN facts f ON f.tail = e.node) GROUP BY ALL)
    SELECT node, side, head, relation AS normalized_relation, tail, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY side, head, relation, tail) rank FROM hits) WHERE rank <= 10"""
)
def one_hop_evidence(spark, d):
    wanted = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.one_hop_evidence(facts(spark, d), wanted)


@query()
def pagerank_tier(spark, d):
    """Tiers of nodes by PageRank over all facts; an iteration, so without SQL."""
    edges = facts(spark, d).select("head", "tail", F.col("confidence").alias("weight"))
    return graph.pagerank_tiers(edges)


@query(
    """WITH named AS (SELECT p_partkey node, p_name AS name, min(p_partkey) OVER (PARTITION BY p_name) g, count(*) OVER (PARTITION BY p_name) size FROM part) SELECT node, g AS "group", name AS canonical, size FROM named"""
)
def fusion_groups(spark, d):
    """Parts fused by their names."""
    names = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    return graph.fused_groups(names.select(F.col("node").alias("u"), F.col("node").alias("v")), names)


@query(
    """WITH RECURSIVE n AS (SELECT vec_id node, p_name || ' ' || p_brand || ' ' || p_size AS name, nullif(lang, 'es') AS type, embedding::DOUBLE[] v FROM embeddings LEFT JOIN documents ON doc_id = vec_id LEFT JOIN part ON p_partkey = vec_id),
    l AS MATERIALIZED (SELECT a.node u, b.node v FROM n a JOIN n b ON a.node <> b.node AND (a.name = b.name OR ((a.type IS NULL OR b.type IS NULL OR a.type = b.type) AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.42))),
    r AS (SELECT node, node g FROM n UNION SELECT r.node, l.v FROM r JOIN l ON r.g = l.u), g AS (SELECT node, min(g) g FROM r GROUP BY node)
    SELECT g.node, g AS "group", first_value(name) OVER (PARTITION BY g ORDER BY len(string_split(name, ' ')) DESC, length(name) DESC, lower(name) DESC) canonical, count(*) OVER (PARTITION BY g) size,
      first_value(type) OVER (PARTITION BY g ORDER BY type IS NULL, g.node) node_type FROM g JOIN n USING (node)"""
)
def entity_fusion(spark, d):
    """Vectors as entities, with a part's name and a document's language as their type, fused by name or by cosine."""
    e, doc, part = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("embeddings", "documents", "part"))
    nodes = e.join(doc, doc.doc_id == e.vec_id, "left").join(part, part.p_partkey == e.vec_id, "left")
    name = F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string"))
    return graph.fused(nodes.select(F.col("vec_id").alias("node"), name.alias("name"), F.nullif("lang", F.lit("es")).alias("type"), F.col("embedding").alias("vector")), 0.42)


@query(
    """WITH b AS (SELECT DISTINCT p_brand brand, p_type kind FROM part), s AS (SELECT p_brand brand, count(*) n FROM part GROUP BY 1)
    SELECT p_partkey AS id, coalesce((SELECT string_agg(kind, ',' ORDER BY kind) FROM (SELECT kind FROM (SELECT DISTINCT p_type kind FROM part) t
      WHERE kind <> p.p_type AND kind NOT IN (SELECT kind FROM b WHERE b.brand = p.p_brand) ORDER BY kind LIMIT 3)), '') distractors FROM part p"""
)
def option_mining(spark, d):
    """Wrong answers to the question of a part's kind: kinds that its brand doesn't have."""
    part = spark.read.parquet(f"{d}/part.parquet")
    pool = part.select(F.col("p_brand").alias("head"), F.lit("kind").alias("relation"), F.col("p_type").alias("tail"))
    asked = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("head"), F.lit("kind").alias("relation"), F.col("p_type").alias("answer"))
    return sampling.distractors(asked, pool).select("id", F.array_join("distractors", ",").alias("distractors"))


@query(
    """WITH w AS (SELECT n_name AS name, avg(c_acctbal) v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), q AS (SELECT c_custkey id, upper(n_name) AS key FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT id, key, round(v, 6) AS value, CASE WHEN key = w.name THEN 'exact' ELSE 'canonical' END strategy FROM q JOIN w ON lower(w.name) = lower(key)"""
)
def lookup_chain(spark, d):
    """A weight for each customer's nation by its name, written otherwise."""
    customer, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation"))
    both = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    exact = both.groupBy(F.col("n_name").alias("name")).agg(F.avg("c_acctbal").alias("value"))
    rows = both.select(F.col("c_custkey").alias("id"), F.upper("n_name").alias("key"))
    return triples.with_fallbacks(rows, "key", exact, exact.select(F.col("name").alias("alias"), "name")).withColumn("value", F.round("value", 6))


@query(
    f"""WITH {FACTS}, l AS (SELECT DISTINCT tail term, head AS next FROM facts), r0 AS (SELECT DISTINCT tail term FROM facts WHERE relation = 'part_of'),
    r1 AS (SELECT next AS term, min(l.term) parent FROM r0 JOIN l USING (term) WHERE next NOT IN (SELECT term FROM r0) GROUP BY 1),
    r2 AS (SELECT next AS term, min(l.term) parent FROM r1 JOIN l USING (term) WHERE next NOT IN (SELECT term FROM r0 UNION SELECT term FROM r1) GROUP BY 1),
    r3 AS (SELECT next AS term, min(l.term) parent FROM r2 JOIN l USING (term) WHERE next NOT IN (SELECT term FROM r0 UNION SELECT term FROM r1 UNION SELECT term FROM r2) GROUP BY 1)
    SELECT term, 0 AS round, NULL parent FROM r0 UNION ALL SELECT term, 1, parent FROM r1 UNION ALL SELECT term, 2, parent FROM r2 UNION ALL SELECT term, 3, parent FROM r3"""
)
def frontier_expansion(spark, d):
    """Nodes within three steps of any region, round by round, over all facts."""
    edges = facts(spark, d)
    seeds = edges.filter("normalized_relation = 'part_of'").select(F.col("tail").alias("term"))
    return graph.expanded(seeds, edges.select(F.col("tail").alias("term"), F.col("head").alias("next")).distinct(), 3)
