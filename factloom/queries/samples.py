"""Samples made of facts, their gates, lookups, and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import repair as R
from factloom.functions import text as T
from factloom.operators import diffs, lookups, samples

from .base import FACTS, facts, query, table



_COUNTS = """counted AS (SELECT head, relation, tail, min(tail_type) tail_type, count(DISTINCT (doc_id, chunk_id)) n, count(DISTINCT doc_id) docs, count(DISTINCT CASE WHEN chunk_id <> '' THEN doc_id || '#' || chunk_id END) chunks, avg(confidence) conf FROM facts GROUP BY head, relation, tail)"""
_LEVEL = "CASE WHEN docs >= 2 THEN 'multi_doc' WHEN chunks >= 2 THEN 'multi_chunk' ELSE 'single_source' END"


@query(
    f"""WITH {FACTS}, {_COUNTS} SELECT 'one_hop_tail|' || head || '|' || relation || '|' || tail uniqueness_key, tail answer, tail_type answer_type, n support_count, docs doc_count, chunks chunk_count, round(conf, 6) confidence,
    {_LEVEL} support_level, CASE WHEN n > 1 THEN 'medium' ELSE 'easy' END difficulty FROM counted"""
)
def edge_samples(spark, d):
    """A question for every fact."""
    found = samples.single_edge_samples(samples.edge_support(facts(spark, d)), "one_hop_tail")
    return found.select("uniqueness_key", "answer", "answer_type", "support_count", "doc_count", "chunk_count", F.round("confidence", 6).alias("confidence"), "support_level", "difficulty")


def _chains(spark, d):
    """Orders, their customers, and where these live."""
    return samples.edge_support(facts(spark, d).filter("normalized_relation <> 'supplies'"))


@query(
    f"""WITH {FACTS}, {_COUNTS}, c AS (SELECT * FROM counted WHERE relation <> 'supplies')
    SELECT concat_ws('|', 'two_hop_tail', a.head, a.relation, a.tail, b.relation, b.tail) uniqueness_key, a.tail answer, a.tail anchor_entity, 'two_hop_middle' anchor_role, 'hard' difficulty, round((a.conf + b.conf) / 2, 6) confidence,
      a.n >= 1 AND b.n >= 1 chain_once, a.n >= 2 AND b.n >= 2 chain_twice FROM c a JOIN c b ON a.tail = b.head WHERE a.head <> b.tail"""
)
def chain_samples(spark, d):
    """Questions over two facts, with their anchors, and whether each hop has one source or two."""
    edges = _chains(spark, d)
    found = samples.with_hop_supports(samples.anchored(samples.two_hop_samples(edges)), edges)
    holds = lambda n: samples.chain_holds(F.col("edges"), "answer", F.col("supports"), n)
    return found.select("uniqueness_key", "answer", "anchor_entity", "anchor_role", "difficulty", F.round("confidence", 6).alias("confidence"), holds(1).alias("chain_once"), holds(2).alias("chain_twice"))


_DOCS = """s AS (SELECT d.doc_id, CASE doc_id % 4 WHEN 0 THEN 'essay' WHEN 1 THEN 'experiment_code' WHEN 2 THEN 'claim_choice' ELSE 'vqa' END kind, doc_id % 3 n_options, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
v AS (SELECT *, CASE WHEN quality IS NULL THEN 'pending' WHEN doc_id % 10 = 0 OR quality = 1 THEN 'passed' ELSE 'rejected' END status FROM s)"""


def _judged(spark, d):
    """Documents as samples, with their labels as a model's verdicts; every tenth came without the model."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    kinds = F.array(*map(F.lit, ("essay", "experiment_code", "claim_choice", "vqa")))
    rows = docs.select("doc_id", F.get(kinds, F.col("doc_id") % 4).alias("question_type"), (F.col("doc_id") % 3).alias("n_options"), F.lit("pending").alias("validation_status"))
    verdict = F.when(F.col("quality") == 1, "supported").when(F.col("toxic") == 1, "contradicted").otherwise("insufficient_evidence")
    tags = F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("model_unavailable"))).otherwise(F.array().cast("array<string>"))
    return samples.with_verdicts(rows, labels.select("doc_id", verdict.alias("verdict"), tags.alias("issue_tags")), "doc_id")


@query(
    f"""WITH {_DOCS} SELECT doc_id, status, CASE WHEN quality IS NULL THEN 'rule_only' WHEN doc_id % 10 = 0 THEN 'degraded' ELSE 'hybrid_model' END AS validation_mode,
      CASE WHEN quality IS NULL OR doc_id % 10 = 0 OR quality = 1 THEN '' WHEN toxic = 1 THEN 'model_contradicted' ELSE 'model_insufficient_evidence' END reasons, coalesce(quality = 1 AND doc_id % 10 <> 0, false) double_checked,
      status = 'passed' AND (kind IN ('essay', 'experiment_code') OR n_options >= 2) AS is_accepted FROM v"""
)
def verdict_gate(spark, d):
    found = _judged(spark, d)
    kept = samples.accepted("question_type", "validation_status", F.col("n_options"))
    return found.select("doc_id", F.col("validation_status").alias("status"), "validation_mode", F.array_join("rejection_reasons", ",").alias("reasons"), "double_checked", kept.alias("is_accepted"))


@query(f"""WITH {_DOCS} SELECT status, kind, count(*) n FROM v GROUP BY ALL""")
def validation_counts(spark, d):
    return diffs.histogram(_judged(spark, d).select(F.struct(F.col("validation_status").alias("status"), F.col("question_type").alias("kind")).alias("x")), "x").select("x.*", "n")


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'experiment_code' ELSE 'vqa' END kind, CASE WHEN doc_id % 3 = 0 THEN 8 ELSE 7 END n FROM documents) SELECT doc_id, kind <> 'experiment_code' OR n = 8 AS complete FROM r"""
)
def experiment_keys(spark, d):
    """Documents as coding questions, two thirds of which lack one of the keys."""
    keys = F.array(*map(F.lit, samples.EXPERIMENT_KEYS))
    kind = F.when(F.col("n_chars") % 2 == 0, "experiment_code").otherwise("vqa")
    have = F.when(F.col("doc_id") % 3 == 0, keys).otherwise(F.slice(keys, 1, 7))
    return table(spark, d, "documents").select("doc_id", samples.has_experiment_keys(kind, have).alias("complete"))


@query(
    """WITH h AS (SELECT user_id, count(DISTINCT event_type) FILTER (event_id % 3 <> 0) n FROM events GROUP BY 1), u AS (SELECT DISTINCT l_suppkey user_id FROM lineitem)
    SELECT user_id, coalesce(n, 0) external_doc_support_count, CASE WHEN n IS NULL THEN 'not_requested' WHEN n >= 3 THEN 'corroborated' ELSE 'not_corroborated' END corroboration_status FROM u LEFT JOIN h USING (user_id)"""
)
def corroboration(spark, d):
    """Suppliers as samples, events as hits of which every third is local."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("user_id")).distinct()
    hits = table(spark, d, "events").select("user_id", F.col("event_type").alias("doc_id"), (F.col("event_id") % 3 == 0).alias("is_local"))
    return samples.corroborated(rows, hits, "user_id", 3)


@query(
    """WITH c AS (SELECT doc_id % 100 chunk, max(doc_id) last FROM documents GROUP BY 1), k AS (SELECT DISTINCT user_id, event_id % 120 chunk FROM events)
    SELECT user_id, CAST(last AS VARCHAR) doc_id, CAST(k.chunk AS VARCHAR) chunk_id, md5(text) text_md5 FROM k JOIN c ON k.chunk = c.chunk JOIN documents d ON d.doc_id = last"""
)
def chunk_lookup(spark, d):
    """The chunks behind users' events; of documents with one chunk id the last holds."""
    name = lambda x: x.cast("string").alias("chunk_id")
    chunks = table(spark, d, "documents").select(name(F.col("doc_id") % 100), F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("text"), F.col("doc_id").alias("seq"))
    rows = table(spark, d, "events").select("user_id", name(F.col("event_id") % 120))
    return lookups.supporting_chunks(rows, chunks, "user_id").withColumnRenamed("text", "text_md5")


@query(
    f"""WITH {FACTS}, e AS (SELECT DISTINCT head, relation, tail FROM facts) SELECT e.head, e.relation, e.tail, count(*) n, round(sum(confidence), 6) weight, min(doc_id) first_doc FROM e JOIN facts f ON e.head = f.head AND e.relation = f.relation AND e.tail = f.tail GROUP BY ALL"""
)
def edge_evidence(spark, d):
    """The facts behind every edge, found by canonical names."""
    f = facts(spark, d)
    edges = f.select("head", F.col("normalized_relation").alias("relation"), "tail").distinct()
    loud = edges.select("head", F.upper(F.regexp_replace("relation", "_", " ")).alias("said"), F.upper(F.concat(F.lit("  "), F.col("tail"))).alias("shown"), "relation", "tail")
    found = lookups.edge_evidence(loud.select("head", F.col("said").alias("relation"), F.col("shown").alias("tail"), F.struct("relation", "tail").alias("own")), f)
    return found.groupBy("head", F.col("own.relation").alias("relation"), F.col("own.tail").alias("tail")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("weight"), F.min("doc_id").alias("first_doc"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'img/' || page_id || '.png' WHEN page_id % 3 = 0 THEN 'old.png' END image_path FROM pages""")
def image_backjoin(spark, d):
    pages = table(spark, d, "pages")
    old = F.when(F.col("page_id") % 3 == 0, "old.png")
    rows = pages.select("page_id", F.struct(F.col("page_id").cast("string").alias("question_id"), old.alias("image_path")).alias("meta"))
    images = pages.filter("page_id % 2 = 0").select(F.col("page_id").cast("string").alias("question_id"), F.concat(F.lit("img/"), F.col("page_id"), F.lit(".png")).alias("path"))
    return lookups.with_images(rows, images).select("page_id", "meta.image_path")


@query(
    f"""WITH {FACTS}, nodes AS (SELECT DISTINCT head node FROM facts UNION SELECT tail FROM facts), s AS (SELECT l_orderkey, unnest(['part ' || l_partkey, 'supplier ' || l_suppkey, l_returnflag, 'order ' || l_orderkey]) node FROM lineitem)
    SELECT DISTINCT l_orderkey, node FROM s WHERE node IN (SELECT node FROM nodes)"""
)
def anchored_nodes(spark, d):
    """Orders as samples, and what they mention that is in the graph."""
    f = facts(spark, d)
    nodes = f.select(F.col("head").alias("node")).union(f.select("tail"))
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.array(named("part ", "l_partkey"), named(" supplier ", "l_suppkey")).alias("nodes"), F.array(F.col("l_returnflag"), named("order ", "l_orderkey")).alias("subjects"))
    return lookups.anchored_nodes(rows, ["nodes", "subjects"], nodes, "l_orderkey").distinct()


@query(
    """WITH p AS (SELECT page_id, regexp_extract(lower(url), '^(?:.*?://)?([^/]*)', 1) host, CASE WHEN page_id % 5 = 0 THEN '10.1/' || (page_id % 50) ELSE '' END doi FROM pages)
    SELECT page_id FROM p WHERE (doi = '' OR doi NOT IN (SELECT doi FROM p WHERE page_id % 35 = 0)) AND (host = '' OR host NOT IN (SELECT host FROM p WHERE page_id % 35 = 0))"""
)
def external_hits(spark, d):
    """Pages as hits, without those whose DOI or host every thirty-fifth page has."""
    doi = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://doi.org/10.1/"), F.col("page_id") % 50)).otherwise("N/A")
    rows = table(spark, d, "pages").select("page_id", "url", doi.alias("doi"))
    return lookups.external_only(rows, rows.filter("page_id % 35 = 0")).select("page_id")


@query(
    """WITH c AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN max(turn) ELSE -1 END at_, CASE WHEN conv_id % 3 = 1 THEN arg_max(left(text, 30), turn) ELSE '' END context FROM conversations GROUP BY conv_id),
    m AS (SELECT c.conv_id, turn, CASE WHEN turn = at_ THEN 0 WHEN trim(context) <> '' AND contains(text, trim(context)) THEN 1 ELSE 2 END rank FROM c JOIN conversations USING (conv_id))
    SELECT conv_id, arg_min(turn, rank * 100000 + turn) ts, CASE min(rank) WHEN 0 THEN 'timestamp' WHEN 1 THEN 'context' ELSE 'first' END found_by FROM m GROUP BY conv_id"""
)
def located_messages(spark, d):
    """The turn that a concept of each conversation is about: by its number, by how it begins, or the first."""
    turns = table(spark, d, "conversations")
    concepts = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by(F.substring("text", 1, 30), "turn").alias("start"))
    concepts = concepts.select("conv_id", F.col("conv_id").alias("session"), F.when(F.col("conv_id") % 3 == 0, F.col("last")).otherwise(-1).alias("source_ts"), F.when(F.col("conv_id") % 3 == 1, F.col("start")).otherwise("").alias("context"))
    return lookups.located_message(concepts, turns.select(F.col("conv_id").alias("session"), F.col("turn").alias("ts"), "text"), "conv_id")


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 're') THEN 'name' WHEN contains(lower(p_brand), 're') OR contains(lower(p_type), 're') THEN 'option' END matched FROM part WHERE matched IS NOT NULL""")
def keyword_search(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.array("p_brand", "p_type").alias("options"))
    return lookups.matching(rows, "RE", [("p_name", "name"), ("options", "option")]).select("p_partkey", "matched")


@query(
    """WITH e AS (SELECT p_brand AS type, lower(p_name) k, min(p_name) AS name FROM part GROUP BY ALL), q AS (SELECT p_partkey, p_name, p_brand FROM part)
    SELECT p_partkey AS id, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM e WHERE e.type = q.p_brand AND k <> lower(q.p_name) ORDER BY name LIMIT 3)), '') distractors FROM q"""
)
def type_pool(spark, d):
    """Wrong answers of the right type: other parts' names of the same brand."""
    part = table(spark, d, "part")
    found = lookups.type_distractors(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("answer"), F.col("p_brand").alias("type")), part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("type")))
    return found.select("id", F.array_join("distractors", ",").alias("distractors"))


_ROWS = "SELECT lang, source, n_chars FROM documents WHERE"


@query(f"""SELECT *, 'base' side FROM ({_ROWS} doc_id % 3 <> 0 EXCEPT {_ROWS} doc_id % 2 = 0) UNION ALL SELECT *, 'new' FROM ({_ROWS} doc_id % 2 = 0 EXCEPT {_ROWS} doc_id % 3 <> 0)""")
def row_diff(spark, d):
    docs = table(spark, d, "documents")
    return diffs.row_diff(docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 2 = 0"), ["lang", "source", "n_chars"])


@query(
    """WITH a AS (SELECT p_name AS "key", min(p_type) AS value FROM part WHERE p_size > 10 GROUP BY 1), b AS (SELECT p_name AS "key", max(p_type) AS value FROM part WHERE p_size < 40 GROUP BY 1)
    SELECT coalesce(a."key", b."key") AS "key", a.value base, b.value AS new, CASE WHEN b."key" IS NULL THEN 'missing' WHEN a."key" IS NULL THEN 'extra' WHEN a.value = b.value THEN 'same' ELSE 'changed' END status FROM a FULL JOIN b ON a."key" = b."key" """
)
def vocabulary_diff(spark, d):
    part = table(spark, d, "part")
    value = lambda rows, f: rows.groupBy(F.col("p_name").alias("key")).agg(f("p_type").alias("value"))
    return diffs.map_diff(value(part.filter("p_size > 10"), F.min), value(part.filter("p_size < 40"), F.max))


@query(
    """SELECT 'type' kind, p_brand AS "key", min(p_type) AS value, false is_extension, '1.0+ext' AS version FROM part GROUP BY p_brand UNION ALL SELECT 'alias', n_name, lower(n_name), true, '1.0+ext' FROM nation"""
)
def vocabulary_extended(spark, d):
    base = table(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.min("p_type").alias("value")).select(F.lit("type").alias("kind"), "key", "value", F.lit("1.0").alias("version"))
    return diffs.extended(base, table(spark, d, "nation").select(F.lit("alias").alias("kind"), F.col("n_name").alias("key"), F.lower("n_name").alias("value")))


@query(
    """WITH u AS (SELECT 0 part, c_custkey place, c_mktsegment text FROM customer UNION ALL SELECT 1, p_partkey, ' ' || upper(p_name) || '  ' FROM part UNION ALL SELECT 2, p_partkey, p_brand FROM part),
    k AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS "key" FROM u) SELECT "key", CAST(part AS INTEGER) part, place, text FROM (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY part, place) n FROM k WHERE "key" <> '') WHERE n = 1"""
)
def ordered_union(spark, d):
    part, customer = table(spark, d, "part"), table(spark, d, "customer")
    names = part.select(F.col("p_partkey").alias("place"), F.concat(F.lit(" "), F.upper("p_name"), F.lit("  ")).alias("text"))
    return diffs.ordered_union([customer.select(F.col("c_custkey").alias("place"), F.col("c_mktsegment").alias("text")), names, part.select(F.col("p_partkey").alias("place"), F.col("p_brand").alias("text"))], "text", "place")


@query(
    f"""WITH {FACTS}, a AS (SELECT DISTINCT head, relation, tail FROM facts WHERE seq % 5 <> 0), b AS (SELECT DISTINCT head, relation, tail FROM facts WHERE seq % 3 <> 0),
    j AS (SELECT coalesce(a.relation, b.relation) relation, a.head IS NOT NULL x, b.head IS NOT NULL y FROM a FULL JOIN b ON a.head = b.head AND a.relation = b.relation AND a.tail = b.tail)
    SELECT relation AS normalized_relation, count(*) FILTER (x) n_base, count(*) FILTER (x AND y) n_both, count(*) FILTER (y) n_new, round(coalesce(count(*) FILTER (x AND y) / nullif(count(*) FILTER (x), 0), 0), 6) recall FROM j GROUP BY 1"""
)
def relation_recall(spark, d):
    f = facts(spark, d)
    found = diffs.relation_recall(f.filter("seq % 5 <> 0"), f.filter("seq % 3 <> 0"), ["head", "normalized_relation", "tail"], "normalized_relation")
    return found.withColumn("recall", F.round("recall", 6))


@query("""SELECT event_id, row_number() OVER w occurrence, row_number() OVER w > 1 is_repeat FROM events WINDOW w AS (PARTITION BY user_id, event_type, CAST(floor(value) AS BIGINT) ORDER BY event_id)""")
def repeated_actions(spark, d):
    rows = table(spark, d, "events").withColumn("size", F.floor("value"))
    return diffs.repeated_actions(rows, ["event_type", "size"], "user_id", "event_id").select("event_id", F.col("occurrence").cast("long").alias("occurrence"), "is_repeat")


@query(
    f"""WITH {FACTS}, n AS (SELECT head, count(DISTINCT tail) n_tails FROM facts GROUP BY 1) SELECT n_tails, count(*) n FROM n GROUP BY 1"""
)
def node_histogram(spark, d):
    pairs = facts(spark, d).select("head", "tail").distinct()
    return diffs.histogram(pairs.groupBy("head").agg(F.count(F.lit(1)).alias("n_tails")), "n_tails")


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: NOT regexp_matches(x, '(?i)\\b(?:{"|".join(R.APOLOGIES).replace("'", "''")})\\b')) k, text FROM documents),
    c AS (SELECT doc_id, regexp_replace(array_to_string(k, chr(10) || chr(10)), '^\\s+|\\s+$', '', 'g') c, text FROM p) SELECT doc_id, md5(CASE WHEN c <> '' THEN c ELSE text END) text_md5 FROM c"""
)
def apologies(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(R.without_apologies("text")).alias("text_md5"))


@query(
    """SELECT conv_id, turn, CASE WHEN lower(role) = 'user' THEN 'Yes' WHEN role = 'system' THEN 'No' ELSE role END AS said, CASE WHEN trim(text) = '' THEN 'empty' WHEN contains(lower(text), '<answer>') OR contains(lower(text), '</answer>') OR regexp_matches(text, '(?i)\\bterminate\\b')
      OR regexp_matches(text, '(?i)\\b(?:option|choice)\\s*\\(?[A-H0-9]+\\)?\\b') OR regexp_matches(text, '(?i)\\bthe (?:correct )?answer is\\b') THEN 'leak_guard' END leak FROM conversations"""
)
def leak_guard(spark, d):
    said = F.when(F.col("role") == "user", " TRUE ").when(F.col("role") == "system", "0").otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", R.yes_no(said).alias("said"), R.leak("text").alias("leak"))


@query(
    f"""SELECT item_id, CASE WHEN regexp_matches(text, '{R.FAULTS}') AND NOT regexp_matches(text, '{R.NO_FAULTS}') THEN 'Yes' ELSE 'No' END AS error, CASE WHEN item_id % 2 = 0 THEN 'yesno' ELSE 'open' END AS format FROM benchmark"""
)
def judgment_payloads(spark, d):
    said = F.when(F.col("item_id") % 2 == 0, " Yes. ").otherwise(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", R.elevated(F.lit("false"), F.lit("no"), "text").alias("error"), R.answer_format(said).alias("format"))


@query(
    """WITH q AS (SELECT page_id, 'Q: ' || regexp_extract(html, '<title>(.*?)</title>', 1) || chr(10) || ' a :  ' || CASE WHEN page_id % 4 = 0 THEN '' ELSE url END x, regexp_extract(html, '<title>(.*?)</title>', 1) t, url FROM pages)
    SELECT page_id, CASE WHEN trim(t) <> '' AND page_id % 4 <> 0 THEN trim(t) END question, CASE WHEN trim(t) <> '' AND page_id % 4 <> 0 THEN trim(url) END answer FROM q"""
)
def question_answers(spark, d):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    told = F.concat(F.lit("Q: "), title, F.lit("\n a :  "), F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("url")))
    qa = R.question_answer(told)
    return table(spark, d, "pages").select("page_id", qa["question"].alias("question"), qa["answer"].alias("answer"))


@query(
    """SELECT p_partkey, length(p_name) > 0 AND (right(lower(p_name), 5) = ' cell' OR right(lower(p_name) || ' cells', 6) = ' cells') AS is_cell, p_brand || '-' || p_type || ' interaction' AS fused FROM part"""
)
def entity_shapes(spark, d):
    """Parts' names as cell types, and brand and kind as an interaction."""
    told = F.concat(F.lit("physical interaction between "), F.col("p_brand"), F.lit(" and "), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", R.is_cell_type(F.concat("p_name", F.lit(" Cells"))).alias("is_cell"), R.interaction(told).alias("fused"))
