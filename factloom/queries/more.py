"""Vocabulary, claims, evidence and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import claims as C
from factloom.functions import python_side as P
from factloom.functions import text as T
from factloom.functions import vocab as V
from factloom.operators import evidence, triples, vectors

from .base import FACTS, facts, query, table

_VOCABULARY = V.Vocabulary(
    types=(V.Rule("matches", "supplier ", "Company"), V.Rule("holds", "customer", "Company"), V.Rule("ends", " 7", "Seventh"), V.Rule("finds", "[0-9]{4,}$", "Large")),
    type_names={"nation": "Place", "region": "Place"},
    relations={"located_in": "associated_with", "placed_by": "involved_in"},
    allowed=("supplies", "associated_with", "involved_in", "part_of"),
)


@query(
    f"""WITH {FACTS}, t AS (SELECT head, tail, relation, CASE WHEN head LIKE 'supplier %' OR head LIKE '%customer%' THEN 'Company' WHEN head LIKE '% 7' THEN 'Seventh' WHEN regexp_matches(head, '[0-9]{{4,}}$') THEN 'Large' WHEN head_type IN ('Nation', 'Region') THEN 'Place' ELSE head_type END AS kind FROM facts)
    SELECT kind, CASE relation WHEN 'located_in' THEN 'associated_with' WHEN 'placed_by' THEN 'involved_in' ELSE relation END AS relation, count(*) n FROM t GROUP BY ALL"""
)
def vocabulary_rules(spark, d):
    """Triples by canonical type and relation."""
    f = facts(spark, d)
    rows = f.select(V.entity_type(_VOCABULARY, "head_type", "head").alias("kind"), V.relation(_VOCABULARY, "normalized_relation", "surface_relation", "tail", "tail_type", "evidence").alias("relation"))
    return rows.groupBy("kind", "relation").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH v AS (SELECT DISTINCT p_name || ' Corp' AS term FROM part)
    SELECT term, term || ' genes, ' || replace(term, 'Corp', 'Company') || ', ' || upper(array_to_string(list_transform(string_split(term, ' '), lambda w: left(w, 1)), '')) AS variants FROM v"""
)
def keyword_variants(spark, d):
    names = table(spark, d, "part").select(F.concat(F.col("p_name"), F.lit(" Corp")).alias("term")).distinct()
    found = V.keyword_variants("term", {}, {"corp": ["Company"]}, ("genes",))
    by = lambda how: F.transform(F.filter(found, lambda v: v["how"] == how), lambda v: v["variant"])
    return names.select("term", F.array_join(F.concat(by("suffix"), by("replacement"), by("acronym")), ", ").alias("variants"))


_TERMS = "list_slice(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9+.-]+'), lambda w: trim(w, ' .,+-')), lambda w: w <> '' AND NOT list_contains([{words}], w) AND (length(w) >= 3 OR regexp_matches(w, '[0-9]')))), 1, 100000)".format(
    words=", ".join(f"'{w}'" for w in C.GENERIC_WORDS)
)


@query(f"""SELECT item_id, CAST(len({_TERMS}) AS BIGINT) n_terms, array_to_string(list_sort({_TERMS}), ' ') terms FROM benchmark""")
def relevance_terms(spark, d):
    terms = C.relevance_terms("text", 100000)
    return table(spark, d, "benchmark").select("item_id", F.size(terms).cast("long").alias("n_terms"), F.array_join(F.sort_array(terms), " ").alias("terms"))


@query(
    """WITH m AS (SELECT doc_id, lower(text) x FROM documents) SELECT doc_id, regexp_matches(x, '(^|[^\\p{L}\\p{N}_])the([^\\p{L}\\p{N}_]|$)') AND regexp_matches(x, '(^|[^\\p{L}\\p{N}_])of([^\\p{L}\\p{N}_]|$)') AS mentioned FROM m"""
)
def concept_mentions(spark, d):
    return table(spark, d, "documents").select("doc_id", C.mentions("text", F.lit("The  of")).alias("mentioned"))


@query(
    f"""WITH {FACTS}, s AS (SELECT head, relation, tail, count(DISTINCT (doc_id, chunk_id)) n FROM facts GROUP BY ALL)
    SELECT head, tail, CASE WHEN relation = 'part_of' THEN 'The evidence suggests a reported association involving ' || head || ' and ' || tail || '.'
      ELSE 'The evidence supports a contextual relationship in which ' || head || ' ' || replace(relation, '_', ' ') || ' ' || tail || '.' END AS claim,
      concat_ws(',', CASE WHEN n < 2 THEN 'insufficient_multi_source_support' END, CASE WHEN relation = 'part_of' THEN 'question_type_not_allowed' END) AS reasons FROM s"""
)
def claim_validation(spark, d):
    """Every edge as a claim, with the rules that keep it from being asked."""
    s = triples.support(facts(spark, d), "head", "normalized_relation", "tail")
    strength = T.evidence_strength(F.array(T.relation_strength("normalized_relation")), F.array(F.col("support_count").cast("int")), F.lit(0.0))
    s = s.withColumn("strength", strength)
    reasons = C.failed(insufficient_multi_source_support=F.col("support_count") >= 2, question_type_not_allowed=F.col("strength") != "weak")
    return s.select("head", "tail", C.claim_text("head", "normalized_relation", "tail", "strength").alias("claim"), F.array_join(reasons, ",").alias("reasons"))


@query(
    """WITH b AS (SELECT doc_id, min(item_id) item FROM (SELECT doc_id, CAST(doc_id % 40 AS BIGINT) item_id FROM documents) GROUP BY 1)
    SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'label' WHEN d.n_chars > 1000 THEN 'length' ELSE 'none' END AS layer FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def evidence_chain(spark, d):
    """The first layer that says something about a document."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    first = labels.filter("quality = 1").select("doc_id", F.lit("good").alias("evidence"))
    second = docs.filter("n_chars > 1000").select("doc_id", F.lit("long").alias("evidence"))
    return evidence.first_layer(docs.select("doc_id"), "doc_id", [("label", first), ("length", second)]).select("doc_id", "layer")


@query(
    """SELECT source AS "key", count(*) n_evidence, count(DISTINCT lang) n_docs, CASE WHEN count(*) < 40 OR count(DISTINCT lang) < 2 THEN 'too_few' WHEN source = 'src1' THEN 'accept' ELSE 'reject' END AS outcome FROM documents GROUP BY source"""
)
def proposal_gate(spark, d):
    raw = table(spark, d, "documents").select(F.lit("type").alias("kind"), F.col("source").alias("key"), F.col("lang").alias("doc_id"))
    verdicts = raw.filter("key = 'src1'").select("kind", "key").distinct().withColumn("decision", F.lit("accept"))
    return evidence.proposals(raw, verdicts, 40, 2).select("key", "n_evidence", "n_docs", "outcome")


@query(
    """WITH h AS (SELECT user_id q, event_type s FROM events) SELECT q AS user_id, count(*) n_hits, count(DISTINCT s) n_sources, count(*) >= 60 AND count(DISTINCT s) >= 4 AS is_grounded FROM h GROUP BY q"""
)
def grounding_gate(spark, d):
    return evidence.grounded(table(spark, d, "events"), "user_id", "event_type", 60, 4)


@query("""SELECT DISTINCT text_md5 FROM (SELECT md5(text) text_md5, source FROM documents) WHERE text_md5 NOT IN (SELECT md5(text) FROM documents WHERE source IN ('src0', 'src1'))""")
def cache_misses(spark, d):
    """Texts that a cache filled from two sources lacks."""
    rows = table(spark, d, "documents").select(F.md5("text").alias("text_md5"), "source")
    cache = rows.filter("source IN ('src0', 'src1')").select("text_md5").distinct().withColumn("value", F.lit(1))
    return evidence.cache_split(rows, cache, "text_md5")[1]


@query(
    """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id query, e.vec_id id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) s FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
    SELECT query, id, round(s, 6) similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) n FROM s) WHERE n <= 3"""
)
def nearest_vectors(spark, d):
    """The three vectors most like each whose id is divisible by 20."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.nearest(rows.filter("id % 20 = 0"), rows, 3).withColumn("similarity", F.round("similarity", 6))


@query(
    """SELECT item_id, string_agg(o, ',' ORDER BY k) options FROM (SELECT item_id, o, sha1('s|' || item_id || '|' || i) k FROM benchmark, (VALUES (0, 'a'), (1, 'b'), (2, 'c'), (3, 'd')) t(i, o)) GROUP BY item_id"""
)
def option_order(spark, d):
    options = F.array(*map(F.lit, "abcd"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(evidence.permuted(options, F.col("item_id"), "s"), ",").alias("options"))


_PIECE = f"p <> '' AND NOT regexp_matches(p, '{C._BOILERPLATE}') AND (length(p) >= 40 OR regexp_matches(p, '{C._SECTIONS}'))"


@query(
    rf"""WITH h AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) t FROM pages),
    m AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(t, ' | ', chr(10)), '{C._PARTING}', chr(10) || '\1' || chr(10), 'g'), '[\n\r]+'), lambda p: trim(p)), lambda p: {_PIECE}) ps, lower(t) low,
      len(regexp_extract_all(t, '[A-Z][^.?!]{{40,}}[.?!]')) n, list_filter(string_split(trim(regexp_replace(lower(title), '\s+', ' ', 'g')), ' '), lambda w: length(w) > 3) ws FROM h)
    SELECT page_id, length(array_to_string(list_filter(ps, lambda p, i: list_position(list_transform(ps, lambda x: lower(x)), lower(p)) = i), chr(10))) n_chars,
      length(t) >= 200 AND len(regexp_extract_all(t, '{C._BOILERPLATE}')) < 8 AND len(regexp_extract_all(low, 'window\.|document\.|font-family|@media')) < 2 AND n >= 2 AND (len(ws) = 0 OR len(list_filter(ws, lambda w: contains(low, w))) > 0) AND (n >= 3 OR regexp_matches(t, '{C._SECTIONS}')) AS is_article FROM m"""
)
def landing_pages(spark, d):
    """Pages as articles: their cleaned text's length and whether they pass for one."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), T.html_text("html").alias("text"))
    return pages.select("page_id", F.length(C.landing_pieces("text")).alias("n_chars"), C.is_article("text", "title", 200).alias("is_article"))


@query()
def text_blocks(spark, d):
    """Documents in blocks that end at sentences."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(P.text_blocks("text")).alias("block", "text")).select("doc_id", "block", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))
