"""Anchors in texts, nested values, tools' answers, questions on images and the content of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import anchors, pages, tool_text
from factloom.operators import nested, overlay

from .base import query, table


@query(
    r"""WITH p AS (SELECT doc_id, text, string_split(text, 'de la') parts FROM documents), t AS (SELECT *, parts[len(parts)] tail FROM p),
    f AS (SELECT *, length(text) - length(tail) base, regexp_split_to_array(tail, 'de\s+la') gaps, regexp_extract_all(tail, 'de\s+la') hits FROM t),
    e AS (SELECT doc_id, list_sum(list_transform(parts[1:i], lambda x: length(x))) + 5 * (i - 1) AS first, 5 AS n FROM (SELECT *, unnest(range(1, len(parts))) i FROM t)
      UNION ALL SELECT doc_id, base + list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0), length(hits[i]) FROM (SELECT *, unnest(range(1, len(hits) + 1)) i FROM f))
    SELECT doc_id, CAST(first AS INTEGER) first, CAST(first + n AS INTEGER) AS last FROM e"""
)
def anchor_places(spark, d):
    """All places of two words in every text, whatever white space is between them behind the last with a single space."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(anchors.anchor_spans("text", F.lit("de la"))).alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("first"), F.col("s.end").alias("last"))


@query(
    r"""WITH v AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) whole, text FROM conversations), b AS (SELECT *, regexp_replace(whole, '^[ .:-]+|[ .:-]+$', '', 'g') bare FROM v),
    c AS (SELECT *, list_transform([',', '.', ';'], lambda e: regexp_replace(split_part(CASE WHEN bare <> '' THEN bare ELSE whole END, e, 1), '^[ .:-]+|[ .:-]+$', '', 'g')) heads FROM b)
    SELECT conv_id, turn, len(list_distinct(list_filter([whole, bare] || list_filter(heads, lambda h: length(h) >= 24), lambda x: x <> ''))) n FROM c"""
)
def anchor_forms(spark, d):
    """Under how many forms each turn could be quoted."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(anchors.anchor_variants("text")).cast("bigint").alias("n"))


def _packed(spark, d):
    """Every conversation as a JSON text, its turns nested two levels deep."""
    turn = F.struct("turn", F.struct(F.col("role").alias("name")).alias("source"), F.array(F.struct(F.col("text").alias("the text"))).alias("content"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", F.to_json(F.struct("conv_id", "turns")).alias("packed"))


@query(
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 i FROM conversations)
    SELECT conv_id, '$.turns[' || i || '].source.name' path, role AS text FROM t UNION ALL SELECT conv_id, '$.turns[' || i || '].content[0][''the text'']', text FROM t"""
)
def nested_strings(spark, d):
    """Every string of every conversation with its path."""
    return nested.walked(_packed(spark, d), "packed", ["conv_id"])


@query("""SELECT conv_id, turn, regexp_replace(role, '[aeiou]', '*', 'g') AS role, regexp_replace(text, '[aeiou]', '*', 'g') AS text FROM conversations""")
def nested_redaction(spark, d):
    """Conversations whose vowels are made neutral inside the JSON, read again from it."""
    kind = "struct<turns: array<struct<turn: bigint, source: struct<name: string>, content: array<struct<`the text`: string>>>>>"
    new = _packed(spark, d).select("conv_id", F.from_json(nested.rewritten("packed", lambda x: F.regexp_replace(x, "[aeiou]", "*")), kind).alias("v"))
    return new.select("conv_id", F.inline("v.turns")).select("conv_id", "turn", F.col("source.name").alias("role"), F.get("content", F.lit(0))["the text"].alias("text"))


@query(
    """SELECT doc_id, 0 AS n, lang || ' ' || doc_id AS title, CAST(n_chars AS VARCHAR) AS "year", source AS venue, NULL AS doi FROM documents UNION ALL SELECT doc_id, 1, source, NULL, NULL, CAST(doc_id AS VARCHAR) FROM documents"""
)
def tool_records(spark, d):
    """Records of documents, written as a search tool does, as rows."""
    s = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("[1] "), "lang", F.lit(" "), s("doc_id"), F.lit("\r\nYear: "), s("n_chars"), F.lit("\nVenue:  "), "source", F.lit("\n\n [2] "), "source", F.lit("\nDOI: "), s("doc_id"))
    return tool_text.records(table(spark, d, "documents").select("doc_id", text.alias("text")), "text", ["doc_id"]).select("doc_id", "n", "title", "year", "venue", "doi")


@query(
    """WITH d AS (SELECT *, doc_id % 50 k, CASE WHEN doc_id % 7 = 0 THEN lang ELSE upper(source) END tail FROM documents),
    i AS (SELECT image_key, min(path) path FROM (SELECT lang || '::' || source || '::' || k image_key, 'img/' || doc_id path FROM d WHERE k % 2 = 0 UNION ALL SELECT source || '::' || k, 'short/' || doc_id FROM d WHERE k % 3 = 0) GROUP BY 1),
    q AS (SELECT *, unnest([1, 2, 3, 4]) place, unnest(['Set::' || lang || '::' || source || '::' || k, lang || '::' || source || '::' || k, source || '::' || k, CAST(k AS VARCHAR)]) suffix FROM d WHERE lower(source) = lower(tail)),
    b AS (SELECT doc_id, lang, min_by(image_key, place) image_key, min_by(path, place) path FROM q JOIN i ON suffix = image_key GROUP BY ALL)
    SELECT image_key, min(path) image_path, 'benchmark::benchmark::Set::' || min_by(lang, doc_id) || '::' || split_part(image_key, '::', -2) || '::' || split_part(image_key, '::', -1) doc_id, CAST(min(doc_id) AS VARCHAR) question FROM b GROUP BY image_key"""
)
def image_overlay(spark, d):
    """Documents as questions on images: the first of each image, found by the longest suffix of its id."""
    docs = table(spark, d, "documents").withColumn("k", (F.col("doc_id") % 50).cast("string"))
    name, doc = F.concat_ws("::", "lang", "source", "k"), F.col("doc_id").cast("string")
    images = docs.filter("k % 2 = 0").select(name.alias("image_key"), F.concat(F.lit("img/"), doc).alias("path"))
    images = images.union(docs.filter("k % 3 = 0").select(F.concat_ws("::", "source", "k"), F.concat(F.lit("short/"), doc)))
    tail = F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise(F.upper("source"))
    triples = docs.select(F.concat(F.lit("benchmark::benchmark::Set::"), name).alias("doc_id"), F.lit(None).cast("string").alias("chunk_id"), F.col("source").alias("head"), tail.alias("tail"), F.concat(F.lit("Q: "), doc, F.lit("\nA: yes")).alias("evidence"), F.col("doc_id").alias("seq"))
    return overlay.image_questions(triples, images).select("image_key", "image_path", "doc_id", "question")


@query(
    r"""WITH t AS (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') body FROM pages)
    SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(body, '<[^>]*>', '', 'g'), '&(?:amp|lt|gt|quot);?|&[a-z]+;', '', 'g'), '[^A-Za-z]', '', 'g')) letters FROM t"""
)
def main_content(spark, d):
    """The content of every page by its letters; the pages hold it in one part, which is found by its text, not by its name."""
    text = pages.main_text(F.regexp_replace("html", "(?<=</?)article(?=>)", "div"))
    return table(spark, d, "pages").select("page_id", F.md5(F.regexp_replace(text, "[^A-Za-z]", "")).alias("letters"))
