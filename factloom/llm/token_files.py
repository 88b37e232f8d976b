"""Token ids in ORC files (operator 10).

Documents are dealt into ranges of doc_id, encoded in order and written as ORC:
integer columns as run-length stripes with row indexes, and a Bloom filter on
doc_id, so that readers take stripes in parallel and skip those a lookup can't
need. Each row holds the count of ids before it in its file; adding the totals
of the files before gives its place among all ids.

Defined cases: a null or empty text is its end id alone; a null doc_id sorts
first; rows with equal doc_id are ordered by their text's hash; an empty table
gives empty files; only doc_id and text are read, so other columns may have
any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import token_ids
from .common import broadcast_if_small, new_path, stored, whole_text

END_ID = 2
#: Documents whose ids a task holds at once.
BATCH_ROWS = 1000
SCHEMA = "doc_id bigint, at bigint, ids array<int>"


def _encode(path: str, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        words, end, at = token_ids.encoder(path), np.array([end_id], "<u4").tobytes(), 0
        for whole in batches:
            for row in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(row, BATCH_ROWS)
                ids = [words.text(t) + end for t in batch.column("text").cast(pa.binary()).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
                starts = pa.array((at + offsets[:-1]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), starts, lists], ["doc_id", "at", "ids"])
                at += int(offsets[-1])

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of ``docs`` as ORC files at ``path``, in ascending doc_id order over files and rows."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ids = ranged.mapInArrow(_encode(tokenizer or token_ids.default_path(), end_id), SCHEMA)
    ids.write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows of files at ``path``, with the number of each row's file."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return spark.read.schema(SCHEMA).orc(path).select("*", part.alias("part"))


def _digest(batches):
    import zlib

    import pyarrow as pa

    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        raw = memoryview(ids.values.to_numpy(zero_copy_only=True)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        n = pa.array(offsets[1:] - offsets[:-1], pa.int64())
        names = ["doc_id", "part", "at", "n_tokens", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("at"), n, pa.array(crc, pa.int64())], names)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: its place among all ids, its count and the CRC-32 of its ids."""
    schema = "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint"
    rows = stored(read_ids(spark, path).mapInArrow(_digest, schema), "ids")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = broadcast_if_small(totals.select("part", before.alias("before")))  # a row for each file
    return rows.join(starts, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """One document's ids; the filter reaches the stripes' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id") == doc_id)


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    path = new_path(docs.sparkSession, "token-files")
    write_ids(docs, path, tokenizer)
    return digests(docs.sparkSession, path)
