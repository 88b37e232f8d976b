"""Where plans cut their lineage: tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where that is unset and all runs on this machine, as in tests."""
    global _own_dir
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="factloom-")
    return _own_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/factloom/{label}-{uuid.uuid4().hex}"


#: Whether the shuffles of a query go when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage and outlives executors; nothing reads the write's own shuffles again, and they go with it."""
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes the files of a table made by ``stored``, once nothing that is still to run reads it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(spark: SparkSession, rows: int, most: int = 500_000) -> int:
    """Partitions for so many rows, so that none has many more than ``most`` whatever the table's size; the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``rows`` narrow rows; beyond that left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
