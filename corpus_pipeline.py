"""From raw documents to packed training sequences.

Each stage is one training-data operator over all rows that the stage before
it kept, with its decisions carried out: documents that the quality rules
reject go, repeated chunks of lines leave the texts, one document of each group
of near-duplicates stays, sources are mixed to their weights, and what is left
is packed. All stages but the last return the columns of ``documents``, extra
ones included, whatever their names; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import line_chunks, mixing, packing, quality, simhash
from factloom.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that break no rule, of hosts that don't stand out; null and empty texts go, repeated rows each stay or go, a null source is a host of its own."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows without passages that an earlier row has; a null text stays null, a text may end empty, rows that share id and text keep the same lines."""
    return line_chunks.dedup_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least id, of repeated rows one; null and empty texts are one group, a null id is the least."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document, with the words that it takes; texts without words are in no pass, repeated rows are documents of their own."""
    return mixing.mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its place; a null or empty text is its end id alone, repeated rows are packed each."""
    return packing.pack_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can express neither rolling hashes over lines nor packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
