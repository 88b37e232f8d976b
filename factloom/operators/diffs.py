"""Comparing and extending tables of rows and of vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T


def row_diff(base: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``columns`` that only one side has, with ``side`` base or new. One shuffle, nulls equal nulls."""
    both = base.select(*columns, F.lit(True).alias("_b"), F.lit(False).alias("_n")).union(new.select(*columns, F.lit(False), F.lit(True)))
    sides = both.groupBy(*columns).agg(F.max("_b").alias("_b"), F.max("_n").alias("_n"))
    return sides.filter("_b <> _n").select(*columns, F.when(F.col("_b"), "base").otherwise("new").alias("side"))


def map_diff(base: DataFrame, new: DataFrame) -> DataFrame:
    """Each key of two tables (key, value) with both values and status: same, changed, missing (from new) or extra."""
    a, b = base.select("key", F.col("value").alias("base"), F.lit(1).alias("_b")), new.select("key", F.col("value").alias("new"), F.lit(1).alias("_n"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(F.col("base").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, "key", "full").select("key", "base", "new", status.alias("status"))


def extended(base: DataFrame, extensions: DataFrame, kind: str = "kind", key: str = "key") -> DataFrame:
    """``base`` with ``extensions`` appended and nothing replaced, ``is_extension`` marking them; every row's version gets +ext where there are any.

    ``base`` has kind, key, value and version; ``extensions`` kind, key and value.
    """
    some = extensions.agg((F.count(F.lit(1)) > 0).alias("_some"))
    version = base.agg(F.max("version").alias("_v"))
    rows = base.select(kind, key, "value", F.lit(False).alias("is_extension")).union(extensions.select(kind, key, "value", F.lit(True)))
    state = F.broadcast(version.join(some))  # one row
    return rows.join(state).select(kind, key, "value", "is_extension", F.concat("_v", F.when(F.col("_some"), "+ext").otherwise("")).alias("version"))


def ordered_union(parts: list[DataFrame], text: str, order: str) -> DataFrame:
    """Rows of ``parts`` in turn, each text once by its keyword form: the first part's first row; empty ones go."""
    rows = [p.select(F.lit(i).alias("part"), F.col(order).alias("place"), F.col(text).alias("text")) for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, rows).withColumn("key", T.normalize_keyword("text")).filter("key <> ''")
    return every.groupBy("key").agg(F.min(F.struct("part", "place", "text")).alias("first")).select("key", "first.*")


def relation_recall(base: DataFrame, new: DataFrame, keys: list[str], relation: str) -> DataFrame:
    """By relation: distinct facts of ``base``, those that ``new`` has too, those of ``new``, and the recall."""
    both = base.select(*keys, F.lit(1).alias("_b"), F.lit(0).alias("_n")).union(new.select(*keys, F.lit(0), F.lit(1)))
    facts = both.groupBy(*keys).agg(F.max("_b").alias("_b"), F.max("_n").alias("_n"))
    out = facts.groupBy(relation).agg(F.sum("_b").alias("n_base"), F.count_if((F.col("_b") == 1) & (F.col("_n") == 1)).alias("n_both"), F.sum("_n").alias("n_new"))
    return out.withColumn("recall", F.coalesce(F.try_divide("n_both", "n_base"), F.lit(0.0)))


def repeated_actions(actions: DataFrame, signature: list[str], session: str, order: str) -> DataFrame:
    """``actions`` with ``occurrence``, how often a session had the same signature up to then, and ``is_repeat``."""
    n = F.row_number().over(Window.partitionBy(session, *signature).orderBy(order))
    return actions.withColumn("occurrence", n).withColumn("is_repeat", F.col("occurrence") > 1)


def histogram(counts: DataFrame, value: str) -> DataFrame:
    """How many rows have each value."""
    return counts.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
