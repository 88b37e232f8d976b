"""Joins that carry evidence, chunks and images to samples, and leave out what is known already."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.anchors import anchor_span


def supporting_chunks(rows: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """The chunks (doc_id, chunk_id, text) behind each ``key`` of ``rows`` (key, chunk_id), each once.

    A chunk is found by its id alone; of chunks with one id the last by seq holds.
    """
    last = chunks.groupBy("chunk_id").agg(F.max_by(F.struct("doc_id", "text"), "seq").alias("chunk"))
    wanted = rows.select(key, "chunk_id").distinct()  # a chunk that many facts share is joined once for each key
    return wanted.join(last, "chunk_id").select(key, "chunk.doc_id", "chunk_id", "chunk.text")


def edge_evidence(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """``edges`` (head, relation, tail) with the facts that say the same by their canonical names."""
    a = edges.withColumns({"h": T.entity_key("head"), "r": T.relation_key("relation"), "t": T.entity_key("tail")})
    b = triples.select(T.entity_key("head").alias("h"), T.relation_key("normalized_relation").alias("r"), T.entity_key("tail").alias("t"), "doc_id", "chunk_id", "confidence", "evidence")
    return a.join(b, ["h", "r", "t"]).drop("h", "r", "t")


def with_images(rows: DataFrame, images: DataFrame, meta: str = "meta") -> DataFrame:
    """``rows`` with image_path in ``meta`` from ``images`` (question_id, path); those without an image keep what they had, of several paths the first by name counts."""
    found = rows.join(images.groupBy(F.col("question_id").alias("_q")).agg(F.min("path").alias("_p")), F.col(f"{meta}.question_id") == F.col("_q"), "left")
    fields = {f.name for f in rows.schema[meta].dataType}
    before = F.col(f"{meta}.image_path") if "image_path" in fields else F.lit(None).cast("string")
    return found.withColumn(meta, F.col(meta).withField("image_path", F.coalesce("_p", before))).drop("_q", "_p")


def anchored_nodes(samples: DataFrame, names: list[str], nodes: DataFrame, key: str) -> DataFrame:
    """key and node: the distinct entities in the array columns ``names`` of ``samples`` that are in the graph (``nodes``: node)."""
    every = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in names))
    each = samples.select(key, F.explode(F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))).alias("node"))
    return each.join(nodes.select("node").distinct(), "node", "left_semi").select(key, "node")


def external_only(hits: DataFrame, local: DataFrame) -> DataFrame:
    """``hits`` (doi, url) whose DOI and host aren't local; hits with neither stay. ``local`` has doi and url."""
    doi, host = T.doi_norm("doi"), T.host("url")
    dois = local.select(doi.alias("_d")).filter("_d <> ''").distinct()
    hosts = local.select(host.alias("_h")).filter("_h <> ''").distinct()
    kept = hits.join(dois, doi == F.col("_d"), "left_anti")
    return kept.join(hosts, host == F.col("_h"), "left_anti")


def located_message(concepts: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """For each concept (key, session, source_ts, context, perhaps anchor) the message (session, ts, text) it is about, and by what.

    In turn: the message at its time, the first that holds its context, the
    first in which its anchor is found by its words, the first of the session.
    A session's messages are joined to its concepts.
    """
    both = concepts.join(messages.select("session", "ts", "text"), "session")
    context = F.trim(F.coalesce("context", F.lit("")))
    quoted = anchor_span("text", "anchor").isNotNull() if "anchor" in concepts.columns else F.lit(False)
    rank = F.when(F.col("ts") == F.col("source_ts"), 0).when((context != "") & F.contains("text", context), 1).when(quoted, 2).otherwise(3)
    best = both.groupBy(key).agg(F.min(F.struct(rank.alias("rank"), "ts")).alias("b"))
    by = F.element_at(F.array(*map(F.lit, ("timestamp", "context", "anchor", "first"))), F.col("b.rank") + 1)
    return best.select(key, F.col("b.ts").alias("ts"), by.alias("found_by"))


def matching(rows: DataFrame, needle: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Rows in which a text or an array of texts holds ``needle`` in any case, with the first such field (column, name)."""
    low = needle.lower()
    kinds = dict(rows.dtypes)
    holds = lambda c: F.exists(c, lambda x: F.contains(F.lower(x), F.lit(low))) if kinds[c].startswith("array") else F.contains(F.lower(c), F.lit(low))
    where = reduce(lambda a, f: a.when(F.coalesce(holds(f[0]), F.lit(False)), f[1]), fields, F.when(F.lit(False), F.lit("")))
    return rows.withColumn("matched", where).filter(F.col("matched").isNotNull())


def type_distractors(questions: DataFrame, entities: DataFrame, k: int = 3) -> DataFrame:
    """id and the first ``k`` names of the answer's type, in order, that aren't the answer; names that differ in case alone count once.

    ``questions`` has id, answer and type; ``entities`` name and type. Of each
    type k + 1 names are enough, since only the answer's own is left out.
    """
    names = entities.groupBy("type", T.entity_key("name").alias("key")).agg(F.min("name").alias("name")).filter("key <> ''")
    first = _first_names(names, k + 1)
    usable = F.filter("pool", lambda p: p["key"] != T.entity_key("answer"))
    listed = F.transform(F.slice(usable, 1, k), lambda p: p["name"])
    return questions.join(first, "type", "left").select("id", F.coalesce(listed, F.array().cast("array<string>")).alias("distractors"))


def _first_names(names: DataFrame, n: int) -> DataFrame:
    """The first ``n`` names of each type: first of hashed parts of a type, so that a type of many names isn't ranked in one task."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("name"))
    parts = names.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(256)))
    some = parts.withColumn("rank", rank("type", "part")).filter(F.col("rank") <= n)
    return some.withColumn("rank", rank("type")).filter(F.col("rank") <= n).groupBy("type").agg(F.sort_array(F.collect_list(F.struct("name", "key"))).alias("pool"))
