"""Triples: normalizing, deduplicating and aggregating them into edges and nodes.

A triples table has doc_id, chunk_id, head, head_type, surface_relation,
normalized_relation, tail, tail_type, confidence, evidence and seq, the order
in which rows were read, on which every "first" and "last" rests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Parts into which a key's rows without a document are dealt.
PARTS = 64

KEY = ("doc_id", "head", "head_type", "normalized_relation", "tail", "tail_type")

#: Passive relations and the active ones that they turn into.
PASSIVE = {"activated_by": "activates", "inhibited_by": "inhibits", "upregulated_by": "upregulates", "downregulated_by": "downregulates"}


def activated(triples: DataFrame) -> DataFrame:
    """Passive statements with head and tail exchanged and the active relation."""
    key = T.snake_case("surface_relation")
    passive = key.isin(*PASSIVE)
    active = F.try_element_at(F.create_map(*(F.lit(x) for kv in PASSIVE.items() for x in kv)), key)
    swap = lambda a, b: F.when(passive, F.col(b)).otherwise(F.col(a))
    return triples.withColumns(
        {
            "head": swap("head", "tail"), "tail": swap("tail", "head"),
            "head_type": swap("head_type", "tail_type"), "tail_type": swap("tail_type", "head_type"),
            "surface_relation": F.coalesce(active, T.normalize_text("surface_relation")),
            "normalized_relation": F.coalesce(active, T.normalize_text("normalized_relation")),
        }
    )


#: How names of protein families begin, which are no cell lines.
PROTEIN_FAMILY = r"^(?:IGF2BP|HNRNP|hnRNP|BRD|LATS|MST|TMPRSS|FZD|SMC|NSE|CUL)\w*(?:[-/–]\w+)*$"


def drop_reason(generic: tuple[str, ...] = (), relations: tuple[str, ...] = (), types: tuple[str, ...] = (), aliases: tuple[str, ...] = ()) -> Column:
    """Why a row is dropped, or null: the first of the rules that it breaks. Empty lists switch their rules off."""

    def judged(head: Column, tail: Column) -> Column:
        common = lambda x: (x.isin(*generic) if generic else F.lit(False)) | x.endswith(" et al")
        why = F.when((head == "") | (tail == "") | (F.coalesce("normalized_relation", F.lit("")) == ""), "incomplete")
        if relations:
            why = why.when(~F.col("normalized_relation").isin(*relations), "relation")
        if types:
            why = why.when(~F.coalesce(F.col("head_type").isin(*types) & F.col("tail_type").isin(*types), F.lit(False)), "type")
        known = lambda x: T.normalize_keyword(x).isin(*aliases) if aliases else F.lit(False)
        short = lambda t, x: F.col(t).isin("Disease", "ClinicalEndpoint") & F.col(x).rlike("^[A-Z]{2,4}$") & ~known(x)
        family = lambda t, x: (F.col(t) == "CellLine") & F.col(x).rlike(PROTEIN_FAMILY)
        return (
            why.when(F.coalesce(family("head_type", "head") | family("tail_type", "tail"), F.lit(False)), "protein_family")
            .when(head == tail, "self_loop")
            .when(T.looks_like_sentence("head") | T.looks_like_sentence("tail"), "sentence")
            .when(common(head) | common(tail), "generic")
            .when(F.coalesce(short("head_type", "head") | short("tail_type", "tail"), F.lit(False)), "short_name")
            .when(F.col("normalized_relation").isin("downregulates", "upregulates", "regulates_expression_of") & (F.col("head_type") == "Disease") & F.col("tail_type").isin("Gene", "Protein"), "direction")
        )

    return T.let(T.normalize_keyword("head"), lambda head: T.let(T.normalize_keyword("tail"), lambda tail: judged(head, tail)))


def normalized(triples: DataFrame, min_confidence: float = 0.5, **rules) -> DataFrame:
    """Rows above ``min_confidence`` in canonical form with ``drop_reason``; kept rows have none."""
    rows = activated(triples.filter(F.coalesce("confidence", F.lit(0.0)) > min_confidence))
    rows = rows.withColumns({"head": T.clean_entity("head"), "tail": T.clean_entity("tail"), "evidence": T.normalize_text("evidence"), "normalized_relation": T.snake_case("normalized_relation")})
    return rows.withColumn("drop_reason", drop_reason(**rules))


def deduplicated(triples: DataFrame) -> DataFrame:
    """One row per KEY, in closed form of a fold over seq.

    confidence is the greatest, surface_relation that of the first row that has
    it, evidence the longest from that row on, all else the first row's.
    """
    best = triples.groupBy(*KEY).agg(F.max("confidence").alias("confidence"), F.min_by("chunk_id", "seq").alias("chunk_id"), F.min("seq").alias("seq"), F.max(F.struct("confidence", (-F.col("seq")).alias("back"))).alias("top"))
    best = best.select(*KEY, "confidence", "chunk_id", "seq", (-F.col("top.back")).alias("top_seq"))
    at = [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]
    later = triples.alias("t").join(best.alias("b"), at).filter("t.seq >= b.top_seq")
    length = F.length(F.coalesce("t.evidence", F.lit("")))
    return later.groupBy(*(F.col(f"b.{c}") for c in (*KEY, "confidence", "chunk_id", "seq", "top_seq"))).agg(
        F.min_by("t.surface_relation", "t.seq").alias("surface_relation"), F.max_by("t.evidence", F.struct(length, -F.col("t.seq"))).alias("evidence")
    ).drop("top_seq")


def source_key(doc: str = "doc_id", chunk: str = "chunk_id", evidence: str = "evidence") -> Column:
    """What makes evidence independent: its chunk, or its own text where it has no ids; null where it has neither.

    Of such a text the first 1000 characters count, a fixed value of the rule.
    """
    d, c, e = T.normalize_text(doc), T.normalize_text(chunk), T.normalize_text(evidence)
    return F.when((d != "") | (c != ""), F.struct(d.alias("d"), c.alias("c"), F.lit("").alias("e"))).when(e != "", F.struct(F.lit("").alias("d"), F.lit("").alias("c"), F.substring(e, 1, 1000).alias("e")))


def support(triples: DataFrame, *keys: str, wording: tuple[str, ...] = ()) -> DataFrame:
    """Per key: independent sources, documents, mean and greatest confidence; with ``wording`` also chunks and, in ``first``, these columns of the first row by seq.

    Counted level by level, sources within documents within keys, where
    distinct counts would copy every row. Rows are dealt once, by key and
    document; what a document says of a key meets there, and documents are
    partly aggregated before keys are. Rows without a document are dealt into
    parts by source, so that they are no one task's.
    """
    f, n = F.col("confidence"), F.col("confidence").isNotNull()
    best = [F.min(F.struct("seq", *wording)).alias("_first")] if wording else []
    later = [F.min("_first").alias("_first")] if wording else []
    rows = triples.withColumns({"_doc": T.normalize_text("doc_id"), "_source": source_key()})
    rows = rows.withColumn("_part", F.when(F.col("_doc") == "", F.pmod(F.xxhash64("_source"), F.lit(PARTS))).otherwise(0))
    sources = rows.repartition(*keys, "_doc", "_part").groupBy(*keys, "_doc", "_part", "_source").agg(F.sum(f).alias("_sum"), F.count_if(n).alias("_n"), F.max(f).alias("_max"), *best)
    chunks = F.count_if(F.col("_source.c") != "").alias("_chunks")
    documents = sources.groupBy(*keys, "_doc", "_part").agg(F.count("_source").alias("_sources"), chunks, F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), F.max("_max").alias("_max"), *later)
    whole = documents.groupBy(*keys).agg(
        F.sum("_sources").alias("support_count"), F.count_if(F.col("_doc") != "").alias("doc_count"), F.sum("_chunks").alias("chunk_count"),
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("avg_confidence"), F.max("_max").alias("max_confidence"), *later,
    )
    return whole.withColumnRenamed("_first", "first") if wording else whole.drop("chunk_count")


def local_edges(triples: DataFrame) -> DataFrame:
    """Per document and edge: weight, greatest confidence, evidence in order, sources."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"])
    return triples.groupBy("doc_id", "head", "tail", "normalized_relation").agg(
        F.sum("confidence").alias("weight"), F.max("confidence").alias("max_confidence"), said.alias("evidence"),
        F.sort_array(F.collect_set("source")).alias("sources"), F.min("seq").alias("seq"),
    )


def document_order(rows: DataFrame) -> DataFrame:
    """doc_id and doc_order, where each document first appears in ``rows``: triples or their local edges, which give the same."""
    return rows.groupBy("doc_id").agg(F.min("seq").alias("doc_order"))


def global_edges(local: DataFrame, mode: str = "last", order: DataFrame | None = None) -> DataFrame:
    """Edges over all documents: mode ``last`` lets the later document's edge replace the earlier's, ``sum`` adds them up.

    The order of documents is that in which they first appear; ``order`` is
    that of ``document_order`` where the triples are at hand, which spares
    making the local edges for it again.
    """
    keys = ["head", "tail", "normalized_relation"]
    if mode == "sum":
        return local.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.max("max_confidence").alias("max_confidence"), F.count(F.lit(1)).alias("n_docs"))
    order = document_order(local) if order is None else order
    # a column each, all of the same row, so that those that nobody reads are never collected or shuffled
    last = [F.max_by(c, "doc_order").alias(c) for c in ("weight", "max_confidence", "evidence", "sources", "doc_id")]
    return local.join(order, "doc_id").groupBy(*keys).agg(*last)


def nodes(triples: DataFrame) -> DataFrame:
    """Per node: the first type that isn't empty, and its sources."""
    end = lambda side: triples.select(F.col(side).alias("node"), F.nullif(F.col(f"{side}_type"), F.lit("")).alias("node_type"), "seq", "source")
    both = end("head").unionByName(end("tail"))
    typed = F.min_by("node_type", F.when(F.col("node_type").isNotNull(), F.col("seq")))
    return both.groupBy("node").agg(typed.alias("node_type"), F.sort_array(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("mentions"))


def two_hops(edges: DataFrame) -> DataFrame:
    """head, first, pivot, second, tail of every path of two edges that doesn't lead back."""
    a = edges.select(F.col("head").alias("head"), F.col("normalized_relation").alias("first"), F.col("tail").alias("pivot"))
    b = edges.select(F.col("head").alias("pivot"), F.col("normalized_relation").alias("second"), F.col("tail"))
    return a.join(b, "pivot").filter("tail <> head").select("head", "first", "pivot", "second", "tail")


def three_hops(edges: DataFrame) -> DataFrame:
    """Paths of three edges over four different nodes."""
    c = edges.select(F.col("head").alias("tail"), F.col("normalized_relation").alias("third"), F.col("tail").alias("end"))
    return two_hops(edges).join(c, "tail").filter("end <> head and end <> pivot and pivot <> head").select("head", "first", "pivot", "second", "tail", "third", "end")


def sole_pivots(paths: DataFrame) -> DataFrame:
    """(head, first, second, tail) that just one pivot joins, with it."""
    found = paths.groupBy("head", "first", "second", "tail").agg(F.countDistinct("pivot").alias("n"), F.min("pivot").alias("pivot"))
    return found.filter("n = 1").drop("n")


def with_fallbacks(rows: DataFrame, key: str, exact: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` with value and strategy: by the key itself, its canonical form, or an alias of that.

    ``exact`` has name and value, ``aliases`` alias and name.
    """
    low = T.entity_key(key)
    canon = exact.groupBy(T.entity_key("name").alias("_c")).agg(F.min_by("value", "name").alias("_v2"))
    alias = aliases.groupBy(T.entity_key("alias").alias("_a")).agg(F.min("name").alias("_n")).join(exact.select(F.col("name").alias("_n"), F.col("value").alias("_v3")), "_n").drop("_n")
    found = rows.join(exact.select(F.col("name").alias(key), F.col("value").alias("_v1")), key, "left")
    found = found.withColumn("_k", low).join(canon, F.col("_k") == F.col("_c"), "left").join(alias, F.col("_k") == F.col("_a"), "left")
    strategy = F.when(F.col("_v1").isNotNull(), "exact").when(F.col("_v2").isNotNull(), "canonical").when(F.col("_v3").isNotNull(), "alias").otherwise("not_found")
    return found.select(*rows.columns, F.coalesce("_v1", "_v2", "_v3").alias("value"), strategy.alias("strategy"))
