"""Questions on images, from triples whose evidence is a question and its answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.repair import answer_format, question_answer
from factloom.functions.text import col
from factloom.plans.storage import broadcast_if_small, stored

#: What stands before the ids of a benchmark's rows, and between the parts of an id.
PREFIX, PART = "benchmark::", "::"


def suffixes(x) -> Column:
    """An id without leading prefixes and all that is left of it part by part, longest first."""
    bare = F.regexp_replace(F.coalesce(col(x), F.lit("")), f"^(?:{PREFIX})+", "")
    parts = F.split(bare, PART)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), PART))


def longest_suffixes(ids: DataFrame, key: str, known: DataFrame, name: str) -> DataFrame:
    """key and ``name``: for each id the longest of its suffixes that is in ``known`` (name); ids without one are left out.

    Ids and suffixes are told once each, so that a suffix that most ids share is
    one row before it is looked up. What is looked up goes back to the ids by
    a join, whose hot keys are what the index holds of them.
    """
    each = stored(ids.select(key).distinct().select(key, F.posexplode(suffixes(key)).alias("_place", "_suffix")), "suffixes")
    held = each.select("_suffix").distinct().join(known.select(F.col(name).alias("_suffix")).distinct(), "_suffix")
    found = each.join(broadcast_if_small(held), "_suffix")
    return found.groupBy(key).agg(F.min_by("_suffix", "_place").alias(name))


def image_questions(triples: DataFrame, images: DataFrame, order: str = "seq") -> DataFrame:
    """doc_id, image_key, image_path, entity, question, answer, answer_format, evidence and chunk_id: the first question of each image.

    Of ``triples`` those count whose ends are one entity, whose id ends in an
    image's key, and whose evidence is a question with an answer. ``images``
    has image_key and path; of several paths the first by name counts. Ends
    that are null read as empty; first is by ``order``, then by id and evidence.
    """
    same = F.lower(F.coalesce("head", F.lit(""))) == F.lower(F.coalesce("tail", F.lit("")))
    loops = triples.filter(same).withColumn("_qa", question_answer("evidence")).filter(F.col("_qa").isNotNull())
    keys = longest_suffixes(loops, "doc_id", images, "image_key")
    row = F.struct("doc_id", F.col("head").alias("entity"), F.col("_qa.question").alias("question"), F.col("_qa.answer").alias("answer"), "evidence", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"))
    first = loops.join(keys, "doc_id").groupBy("image_key").agg(F.min_by(row, F.struct(order, "doc_id", "evidence", "head")).alias("_row"))
    paths = images.groupBy("image_key").agg(F.min("path").alias("image_path"))
    return first.join(paths, "image_key").select("image_key", "image_path", "_row.*", answer_format("_row.answer").alias("answer_format"))
