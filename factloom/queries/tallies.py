"""Histograms, unions, seeds, prompts and judgments."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import evidence, graph, judging

from .base import FACTS, facts, query, table


@query(
    f"""WITH {FACTS}, ends AS (SELECT head node, head_type kind FROM facts UNION ALL SELECT tail, tail_type FROM facts), n AS (SELECT node, min(kind) kind, count(*) degree FROM ends GROUP BY node)
    SELECT kind, degree, count(*) n_nodes FROM n GROUP BY ALL"""
)
def degree_histogram(spark, d):
    rows = facts(spark, d)
    kinds = rows.select(F.col("head").alias("node"), F.col("head_type").alias("kind")).union(rows.select("tail", "tail_type")).groupBy("node").agg(F.min("kind").alias("kind"))
    return graph.degrees(rows).join(kinds, "node").groupBy("kind", "degree").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"""WITH {FACTS} SELECT relation AS normalized_relation, round_even(confidence, 1) bucket, count(*) n, count(*) FILTER (confidence <= 0.5) n_dropped FROM facts GROUP BY ALL""")
def confidence_buckets(spark, d):
    """Rows by relation and rounded confidence, with those a gate at 0.5 would drop."""
    return facts(spark, d).groupBy("normalized_relation", F.bround("confidence", 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") <= 0.5).alias("n_dropped"))


@query("""SELECT source, lang, count(*) n, count(*) FILTER (n_chars > 1000) n_kept, max(n_chars) longest FROM documents GROUP BY ALL""")
def source_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_kept"), F.max("n_chars").alias("longest"))


@query(
    """SELECT 'document' origin, doc_id id, md5(text) text_md5 FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'benchmark', item_id, md5(text) FROM benchmark WHERE trim(text) <> ''
    UNION ALL SELECT 'turn', conv_id * 1000 + turn, md5(text) FROM conversations WHERE trim(text) <> ''"""
)
def bag_union(spark, d):
    """All texts as one bag, empty ones left out."""
    parts = [("document", "documents", F.col("doc_id")), ("benchmark", "benchmark", F.col("item_id")), ("turn", "conversations", F.col("conv_id") * 1000 + F.col("turn"))]
    rows = [table(spark, d, name).filter(F.trim("text") != "").select(F.lit(origin).alias("origin"), key.alias("id"), F.md5("text").alias("text_md5")) for origin, name, key in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    r"""WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '\b([A-Z][A-Za-z0-9]*[A-Z0-9][A-Za-z0-9-]*|[A-Za-z]+-[0-9A-Za-z-]+|[A-Z][a-z]{4,})\b', 1)) term FROM benchmark),
    c AS (SELECT lower(term) AS "key", count(*) frequency, min(term) term FROM t GROUP BY 1),
    s AS (SELECT *, CASE WHEN regexp_matches(term, '[0-9]') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(term[2:], '[A-Z]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(term, '[/:+-]') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(term, '^[A-Z]{2,4}$') THEN 6 ELSE 0 END AS score
      FROM c WHERE NOT regexp_matches(term, '^[A-Z]{2,4}$') OR frequency >= 2)
    SELECT "key", frequency, term, score FROM s ORDER BY score DESC, frequency DESC, length(term) DESC, "key" LIMIT 50"""
)
def seed_ranking(spark, d):
    """The fifty best names in benchmark items to start from."""
    return evidence.ranked_seeds(table(spark, d, "benchmark"), "text", 50).select("key", "frequency", "term", "score")


@query(
    f"""WITH {FACTS}, e AS (SELECT head, tail FROM facts), deg AS (SELECT node, count(*) degree FROM (SELECT head node FROM e UNION ALL SELECT tail FROM e) GROUP BY 1),
    hub AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1), near AS (SELECT DISTINCT n FROM (SELECT tail n FROM e JOIN hub ON head = node UNION ALL SELECT head FROM e JOIN hub ON tail = node))
    SELECT n AS node, (SELECT node FROM hub) hub, degree FROM near JOIN deg ON n = node ORDER BY degree DESC, n LIMIT 20"""
)
def ego_network(spark, d):
    return graph.ego(facts(spark, d)).select("node", "hub", "degree")


@query(
    """SELECT conv_id, role AS concept, count(*) n_claims, md5(string_agg(md5(text), ',' ORDER BY md5(text))) digest FROM conversations GROUP BY ALL"""
)
def claim_buckets(spark, d):
    rows = table(spark, d, "conversations").withColumn("claim", F.md5("text"))
    return judging.buckets(rows, "conv_id", "role", "claim").select("conv_id", "concept", "n_claims", F.md5(F.array_join("claims", ",")).alias("digest"))


@query(
    """WITH c AS (SELECT conv_id, md5(text) claim, row_number() OVER (PARTITION BY conv_id ORDER BY md5(text)) - 1 place FROM conversations)
    SELECT conv_id, CAST(place AS INTEGER) place, claim, CASE place WHEN 0 THEN 'supported' WHEN 1 THEN 'refuted' ELSE 'unverifiable' END verdict, CASE place WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.5 END score FROM c"""
)
def judge_by_position(spark, d):
    """A judge's list of three verdicts, laid on the claims of every conversation by their places."""
    rows = table(spark, d, "conversations").select("conv_id", F.lit("all").alias("topic"), F.md5("text").alias("claim"))
    bucketed = judging.buckets(rows, "conv_id", "topic", "claim")
    outputs = bucketed.select("conv_id", F.array(F.lit("Supported"), F.lit(" refuted"), F.lit("unsure")).alias("verdicts"))
    return judging.judged(bucketed, outputs, ["conv_id"]).select("conv_id", "place", "claim", "verdict", "score")


@query(
    """WITH s AS (SELECT d.doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE -1 END expected, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN lang ELSE 'z' END answer FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT doc_id, CASE WHEN answer IS NULL OR answer = 'z' THEN -1 ELSE expected END picked, CASE WHEN answer IS NULL THEN 'missing_answer' WHEN answer = 'z' THEN 'unparseable_answer' ELSE '' END AS error, CASE WHEN answer IS NULL OR answer = 'z' THEN 0.0 ELSE 1.0 END score FROM s"""
)
def scored_answers(spark, d):
    """Documents as questions for their language, labels as answers; those without a label miss theirs."""
    langs = ["en", "fr", "de", "es"]
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    samples = docs.select("doc_id", F.array(*map(F.lit, langs)).alias("options"), (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int").alias("expected"))
    answers = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("lang")).otherwise("z").alias("answer"))
    return judging.scored_choices(samples, answers, "doc_id").select("doc_id", "picked", "error", "score")


@query(
    """SELECT item_id, md5('Question: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || 'A. yes' || chr(10) || 'B. no') prompt_md5 FROM benchmark"""
)
def choice_prompts(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(judging.choice_prompt("text", F.array(F.lit("yes"), F.lit("no")))).alias("prompt_md5"))


@query(
    """SELECT page_id, greatest(1, length(html) // 4) AS n_tokens, regexp_extract(lower(url), '^(?:.*?://)?([^/]*)', 1) AS host FROM pages"""
)
def page_costs(spark, d):
    return table(spark, d, "pages").select("page_id", T.token_estimate("html").alias("n_tokens"), T.host("url").alias("host"))


@query(
    """SELECT conv_id, CAST(idx AS INTEGER) idx, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) step_md5 FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 idx FROM conversations)
    WHERE role = 'assistant' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''"""
)
def trajectory_steps(spark, d):
    """Conversations nested as trajectories, and what the agent said in them."""
    from factloom.operators import trajectory

    none = F.lit(None).cast("array<struct<tool_name:string,tool_args:string>>")
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("role"), F.col("text")))), lambda x: F.struct(x["role"].alias("source"), F.lit("text").alias("type"), x["text"].alias("text"), none.alias("calls"))).alias("messages"))
    return trajectory.steps(nested, "conv_id", "messages").select("conv_id", "idx", F.md5("step").alias("step_md5"))
