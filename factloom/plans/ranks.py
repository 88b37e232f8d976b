"""Running totals and ranks over a whole table without one task that holds it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, stored


def running_total(df: DataFrame, order: str, value: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows with a smaller ``order``; ``order`` must be unique.

    Rows are dealt into ranges, summed within each, and each range adds the
    totals of those before it, of which there is a row for each range.
    """
    ranged = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = lambda w: F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("_part").agg(F.sum(value).alias("_v"))
    parts = parts.select("_part", before(Window.orderBy("_part")).alias("_before"))
    within = ranged.withColumn("_v", F.col(value)).withColumn("_within", before(Window.partitionBy("_part").orderBy(order)))
    return within.join(broadcast_if_small(parts), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_v", "_within", "_before")


def percent_rank(df: DataFrame, value: str, name: str = "percentile") -> DataFrame:
    """``df`` with the share of the other rows whose ``value`` is smaller; 1 for a row alone."""
    counts = running_total(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), value, "_n", "_smaller")
    n = df.count()
    share = F.lit(1.0) if n == 1 else F.col("_smaller") / F.lit(max(n - 1, 1))
    return df.join(counts.withColumnRenamed(value, "_value"), F.col(value).eqNullSafe(F.col("_value"))).withColumn(name, share).drop("_value", "_n", "_smaller")


def within_group(df: DataFrame, keys: list[str], order: str, most: int | None = None, parts: int = 64) -> DataFrame:
    """``df`` with ``_r``, each row's number in its group by ``order``; rows beyond ``most`` are left out.

    A group of any size is dealt into ranges of ``order``, numbered within each,
    and each range adds what the group has in the ranges before it.
    """
    if most is not None:
        # the first rows of a group are among the first of its hashed parts
        part = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts)))
        some = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order))).filter(F.col("_r") <= most)
        return some.drop("_part").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_r") <= most)
    ranged = stored(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), before.alias("_before"))
    within = ranged.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return within.join(sizes, same).withColumn("_r", F.col("_r") + F.col("_before")).drop("_part", "_p", "_before", *(f"_k{i}" for i in range(len(keys))))


def latest_before(df: DataFrame, keys: list[str], order: str, holds: Column, names: dict[str, list[str]]) -> DataFrame:
    """``df`` with, for each of ``names``, the greatest ``order`` below the row's own among rows of its group for which ``holds``.

    A group is that of ``keys`` and the columns listed for the name; ``order``
    is a whole number. Groups of any size are dealt into ranges of ``order``:
    each range looks into itself and takes what it lacks from the latest range
    before it that has one. Null keys are a group; a null order gets null.
    """
    marked = df.withColumn("_at", F.when(holds, F.col(order)))
    out = stored(marked.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "ranges")
    for name, finer in names.items():
        group = [*keys, *finer]
        ends = out.groupBy(*group, "_part").agg(F.max("_at").alias("_end"))
        # a row for each range that has some of the group
        so_far = F.max("_end").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*group, "_part"])), so_far.alias("_far"))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*group, "_part"])))
        within = F.max("_at").over(Window.partitionBy(*keys, "_part", *finer).orderBy(F.col(order)).rangeBetween(Window.unboundedPreceding, -1))
        found = F.when(F.col(order).isNotNull(), F.coalesce("_near", "_far"))
        out = out.withColumn("_near", within).join(ends, same, "left").withColumn(name, found).drop("_near", "_far", *(f"_k{i}" for i in range(len(group) + 1)))
    return out.drop("_at", "_part").select(*df.columns, *names)
