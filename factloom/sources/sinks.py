"""Sinks with a protocol: documents, result pairs, rewrites that keep a backup, logs; and folders of runs.

Paths are Hadoop paths, so that all of this works on shared stores. A rewrite
writes beside what it reads and renames, so that no failure loses the old
table; two writers at once are not guarded against.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_document(spark: SparkSession, path: str, payload) -> None:
    """One JSON document, indented by two; for summaries, which are small."""
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray((json.dumps(payload, ensure_ascii=False, indent=2) + "\n").encode()))
    finally:
        out.close()


def write_results(rows: DataFrame, summary: dict, folder: str) -> None:
    """``rows`` as JSON lines under ``folder``/results, nested values as they are, and ``summary`` beside them."""
    rows.write.mode("overwrite").json(f"{folder}/results")
    write_document(rows.sparkSession, f"{folder}/summary.json", summary)


def _move(fs, old, new) -> None:
    """Renames, which stores may refuse by saying no instead of raising."""
    if not fs.rename(old, new):
        raise OSError(f"{old} could not be renamed to {new}")


def recover(spark: SparkSession, path: str) -> None:
    """Puts back the table at ``path`` if a rewrite was cut off between its two renames."""
    (old, fs), (aside, _) = _hadoop(spark, path), _hadoop(spark, f"{path}.old")
    if fs.exists(aside) and not fs.exists(old):
        _move(fs, aside, old)


def rewrite(df: DataFrame, path: str) -> None:
    """Puts ``df``, which may read ``path``, in its place as JSON lines; what was there first stays as ``path``.bak.

    The old table is moved aside before the new one is moved in, and goes only
    then. A failure leaves the old table at ``path``, or aside, from where
    ``recover`` and the next rewrite put it back.
    """
    spark = df.sparkSession
    (new, fs), (old, _), (aside, _), (backup, _) = (_hadoop(spark, f"{path}{end}") for end in (".new", "", ".old", ".bak"))
    df.write.mode("overwrite").json(f"{path}.new")
    if fs.exists(old):
        if fs.exists(aside):  # left by a rewrite that was cut off after its second rename
            fs.delete(aside, True)
        _move(fs, old, aside)
    _move(fs, new, old)
    if fs.exists(aside):
        if fs.exists(backup):
            fs.delete(aside, True)
        else:
            _move(fs, aside, backup)


def compacted(spark: SparkSession, path: str, schema: str, good: Column) -> DataFrame:
    """Rewrites the JSON lines at ``path`` without rows that aren't ``good`` (failed ones are tried again later), and reads them back."""
    recover(spark, path)
    rewrite(spark.read.schema(schema).json(path).filter(good), path)
    return spark.read.schema(schema).json(path)


def log_events(events: DataFrame, path: str) -> None:
    """Appends one JSON line an event, with the time of writing as ``timestamp`` where it has none."""
    at = F.current_timestamp()
    stamped = events.withColumn("timestamp", F.coalesce("timestamp", at) if "timestamp" in events.columns else at)
    stamped.write.mode("append").json(path)


def run_folders(spark: SparkSession, root: str, required: tuple[str, ...]) -> list[str]:
    """Names of the folders under ``root`` that hold all ``required`` files, in order; a folder that isn't there has none."""
    p, fs = _hadoop(spark, root)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in found if all(fs.exists(_hadoop(spark, f"{root}/{n}/{f}")[0]) for f in required))
