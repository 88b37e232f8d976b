"""Questions made of facts: samples, their anchors, and the gates that they pass.

Rows of facts are those of ``triples``. A sample is a row of its own, found by
its uniqueness key; the facts behind it stay in the triples table and are
joined back where a gate asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.claims import failed
from factloom.operators.triples import support

#: Types whose answer is free text, and the keys that a coding question needs.
OPEN_TYPES = ("essay", "experiment_code")
EXPERIMENT_KEYS = ("data_code", "main_code", "incomplete_main_code", "incomplete_functions", "unit_tests", "github_references", "task_objective", "research_direction")


def keyed(triples: DataFrame) -> DataFrame:
    """``triples`` with the canonical head, relation and tail by which facts count as the same."""
    return triples.withColumns({"h": T.entity_key("head"), "r": T.relation_key("normalized_relation"), "t": T.entity_key("tail")})


def edge_support(triples: DataFrame) -> DataFrame:
    """A row per fact (h, r, t): the first row's wording, independent sources, documents and chunks, and mean confidence."""
    wording = ("head", "head_type", "normalized_relation", "tail", "tail_type")
    found = support(keyed(triples), "h", "r", "t", wording=wording)
    return found.select("h", "r", "t", *(f"first.{c}" for c in wording), "support_count", "doc_count", "avg_confidence", "chunk_count")


def support_level(docs: Column, chunks: Column) -> Column:
    return F.when(docs >= 2, "multi_doc").when(chunks >= 2, "multi_chunk").otherwise("single_source")


def difficulty(kind: Column, sources: Column) -> Column:
    return F.when(kind == "two_hop_tail", "hard").when(sources > 1, "medium").otherwise("easy")


def single_edge_samples(edges: DataFrame, kind: str) -> DataFrame:
    """A sample of ``kind`` for each row of ``edge_support``."""
    answer = {"single_hop_head": F.col("head"), "boolean_support": F.lit("yes")}.get(kind, F.col("tail"))
    answer_type = {"single_hop_head": F.col("head_type"), "boolean_support": F.lit("Boolean")}.get(kind, F.col("tail_type"))
    subject = F.col("tail") if kind == "single_hop_head" else F.col("head")
    k = F.lit(kind)
    return edges.select(
        F.concat_ws("|", k, "h", "normalized_relation", "t").alias("uniqueness_key"), k.alias("question_type"), subject.alias("subject"), F.col("normalized_relation").alias("relation"),
        answer.alias("answer"), answer_type.alias("answer_type"), F.array(F.struct("head", F.col("normalized_relation").alias("relation"), "tail")).alias("edges"),
        "support_count", "doc_count", "chunk_count", F.col("avg_confidence").alias("confidence"), support_level(F.col("doc_count"), F.col("chunk_count")).alias("support_level"),
        difficulty(k, F.col("support_count")).alias("difficulty"), F.lit("pending").alias("validation_status"),
    )


def two_hop_samples(edges: DataFrame) -> DataFrame:
    """A sample for each chain of two rows of ``edge_support`` over one entity in between, which is the answer."""
    a = edges.select(*(F.col(c).alias(f"{c}_1") for c in edges.columns))
    b = edges.select(*(F.col(c).alias(f"{c}_2") for c in edges.columns))
    both = a.join(b, (F.col("t_1") == F.col("h_2")) & (F.col("h_1") != F.col("t_2")))
    least = lambda c: F.least(f"{c}_1", f"{c}_2")
    k = F.lit("two_hop_tail")
    hop = lambda i: F.struct(F.col(f"head_{i}").alias("head"), F.col(f"normalized_relation_{i}").alias("relation"), F.col(f"tail_{i}").alias("tail"))
    return both.select(
        F.concat_ws("|", k, "h_1", "normalized_relation_1", "t_1", "normalized_relation_2", "t_2").alias("uniqueness_key"), k.alias("question_type"), F.col("head_1").alias("subject"), F.col("normalized_relation_1").alias("relation"),
        F.col("tail_1").alias("answer"), F.col("tail_type_1").alias("answer_type"), F.array(hop(1), hop(2)).alias("edges"),
        least("support_count").alias("support_count"), least("doc_count").alias("doc_count"), least("chunk_count").alias("chunk_count"), ((F.col("avg_confidence_1") + F.col("avg_confidence_2")) / 2).alias("confidence"),
        support_level(least("doc_count"), least("chunk_count")).alias("support_level"), difficulty(k, least("support_count")).alias("difficulty"), F.lit("pending").alias("validation_status"),
    )


def anchored(samples: DataFrame) -> DataFrame:
    """``samples`` with the entity that their answer is about and its role: the tail of the first edge, or unknown without edges."""
    first = F.get("edges", F.lit(0))
    role = F.when(first.isNull(), "unknown").when(F.col("question_type") == "two_hop_tail", "two_hop_middle").otherwise("tail")
    return samples.withColumns({"anchor_entity": F.coalesce(first["tail"], F.lit("")), "anchor_role": role})


def chain_holds(edges: Column, answer, supports: Column, least: int = 2) -> Column:
    """Whether two edges meet in the answer and each has ``least`` independent sources (``supports``, one for each edge)."""
    a, b, middle = F.get(edges, F.lit(0)), F.get(edges, F.lit(1)), T.entity_key(answer)
    meets = (T.entity_key(a["tail"]) == middle) & (T.entity_key(b["head"]) == middle)
    return F.coalesce(b.isNotNull() & meets & F.forall(F.slice(supports, 1, 2), lambda s: s >= least) & (F.size(supports) >= 2), F.lit(False))


def with_hop_supports(samples: DataFrame, edges: DataFrame, key: str = "uniqueness_key") -> DataFrame:
    """``samples`` with ``supports``: for each of a sample's edges, in order, its independent sources by ``edges``; 0 for an unknown one."""
    each = samples.select(key, F.posexplode("edges").alias("hop", "edge"))
    each = each.select(key, "hop", T.entity_key(F.col("edge.head")).alias("h"), T.relation_key(F.col("edge.relation")).alias("r"), T.entity_key(F.col("edge.tail")).alias("t"))
    found = each.join(edges.select("h", "r", "t", "support_count"), ["h", "r", "t"], "left")
    lists = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("hop", F.coalesce("support_count", F.lit(0)).alias("n")))).alias("s"))  # as many as edges
    return samples.join(lists.select(key, F.transform("s", lambda x: x["n"]).alias("supports")), key, "left").withColumn("supports", F.coalesce("supports", F.array().cast("array<bigint>")))


def has_experiment_keys(kind, keys: Column) -> Column:
    """Whether a coding question has all it needs; others always do."""
    needed = F.array(*map(F.lit, EXPERIMENT_KEYS))
    return (T.col(kind) != "experiment_code") | (F.size(F.array_except(needed, F.coalesce(keys, F.array().cast("array<string>")))) == 0)


def rule_reasons(least: int = 2) -> Column:
    """Names of the rules that a sample with ``supports`` and ``metadata_keys`` breaks."""
    kind = F.col("question_type")
    free = kind.isin("vqa", "experiment_code")
    enough = F.when(kind == "two_hop_tail", chain_holds(F.col("edges"), "answer", F.col("supports"), least)).otherwise((F.col("support_count") >= least) | (F.col("doc_count") >= 2) | (F.col("chunk_count") >= 2))
    return failed(insufficient_support=free | enough, incomplete_experiment=has_experiment_keys("question_type", F.col("metadata_keys")), empty_answer=T.normalize_text("answer") != "")


def with_verdicts(samples: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """``samples`` with what a model said of them: validation_status, rejection_reasons, double_checked and validation_mode.

    ``verdicts`` has key, verdict and issue_tags. A verdict that came without
    its model passes a sample unchecked; a sample without a verdict stays as
    it is, pending.
    """
    both = samples.join(verdicts.select(key, F.col("verdict").alias("model_verdict"), "issue_tags"), key, "left")
    asked, down = F.col("model_verdict").isNotNull(), F.coalesce(F.array_contains("issue_tags", "model_unavailable"), F.lit(False))
    good, thin = F.col("model_verdict") == "supported", F.col("model_verdict") == "insufficient_evidence"
    reason = F.when(asked & ~down & thin, "model_insufficient_evidence").when(asked & ~down & ~good, "model_contradicted")
    return both.withColumns(
        {
            "validation_status": F.when(~asked, F.col("validation_status")).when(down | good, "passed").otherwise("rejected"),
            "rejection_reasons": F.array_compact(F.array(reason)),
            "double_checked": F.coalesce(asked & ~down & good, F.lit(False)),
            "validation_mode": F.when(~asked, "rule_only").when(down, "degraded").otherwise("hybrid_model"),
        }
    ).drop("issue_tags")


def accepted(kind, status, n_options: Column) -> Column:
    """Whether a sample is kept: it passed, and is open or has two options or more."""
    return F.coalesce((T.col(status) == "passed") & (T.col(kind).isin(*OPEN_TYPES) | (n_options >= 2)), F.lit(False))


def corroborated(samples: DataFrame, hits: DataFrame, key: str, least: int = 1) -> DataFrame:
    """``samples`` with external_doc_support_count, distinct external documents among ``hits`` (key, doc_id, is_local), and corroboration_status."""
    external = hits.filter(~F.coalesce("is_local", F.lit(False)) & (T.normalize_text("doc_id") != ""))
    counts = external.groupBy(key, "doc_id").agg(F.lit(1).alias("one")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    asked = hits.select(key).distinct().withColumn("asked", F.lit(True))
    both = samples.join(counts, key, "left").join(asked, key, "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    status = F.when(F.col("asked").isNull(), "not_requested").when(n >= least, "corroborated").otherwise("not_corroborated")
    return both.withColumns({"external_doc_support_count": n, "corroboration_status": status}).drop("n", "asked")
