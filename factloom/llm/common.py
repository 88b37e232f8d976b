"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.plans.storage import broadcast_if_small, new_path, shared_dir, stored

__all__ = ["SPACE", "broadcast_if_small", "column", "first_of_repeats", "let", "new_path", "shared_dir", "stored", "table", "whole_text", "with_keys", "words"]

#: ASCII white space; everything else belongs to a word.
SPACE = r"[ \t-\r]+"

def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimizer may copy a column's definition into every place that
    mentions it, lambdas included; a lambda variable can't be copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def column(name: str, of: str = "") -> Column:
    """The column ``name``, or the field of that name in the struct column ``of``, whatever characters the name has."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def whole_text(text: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def with_keys(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``row``, ``k`` and ``h``: every row as a struct, its id without nulls, and the hash of all its columns.

    Rows that agree in k and h are the same row repeated.
    """
    columns = [column(c) for c in docs.columns]
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    return docs.select(F.struct(*columns).alias("row"), k.alias("k"), F.xxhash64(*columns).alias("h"))


def first_of_repeats(keyed: DataFrame) -> DataFrame:
    """One of each set of repeated rows of ``with_keys``; shuffled and sorted as a join on k and h asks for."""
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("k", "h").orderBy("k", "h"))).filter("_n = 1").drop("_n")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
