"""Two tables compared block by block, each block with each, over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def numbered(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df`` written once with ``row``, a number of each row's own."""
    return stored(df.withColumn("row", F.monotonically_increasing_id()), label)


def _dealt(df: DataFrame, name: str, parts: int) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))


def met(left: DataFrame, right: DataFrame, n_left: int, n_right: int, run, columns: str, group: int = 2048, shard: int = 65_536) -> DataFrame:
    """``run(left rows, right rows)``, of Arrow tables, for every group of ``left`` with every shard of ``right``.

    Both have ``row``, by whose hash they are dealt, so that no value makes a
    block larger. Rows of ``right`` are sent once for each group.
    """
    spread = 2 * int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, shards = max(-(-n_left // group), 1), max(-(-n_right // shard), min(spread, -(-n_right // 512)), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = left.select(*(F.col(c).alias(c) for c in left.columns))  # both sides may come from one table
    a = _dealt(own, "g", groups).withColumn("s", every(shards))
    b = _dealt(right, "s", shards).withColumn("g", every(groups))
    return a.groupBy("g", "s").cogroup(b.groupBy("g", "s")).applyInArrow(run, columns)
