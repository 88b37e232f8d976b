"""Packing documents into sequences of bounded length (operator 3).

A document's ids are cut into full pieces and a rest. The histogram of piece
lengths, at most one entry for each length up to the maximum, goes to the
driver, where lengths are placed longest first, each into the shortest pack
that has room, as counts of packing patterns. Pieces find their place by their
rank among pieces of equal length: ranks are counted within hashed buckets, so
that a length which a third of all pieces share is spread over many tasks.

Defined cases: a null or empty text is one piece, its end id; repeated rows are
packed each on their own; an empty table gives an empty result; only doc_id and
text are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import token_ids
from .common import broadcast_if_small, stored, whole_text

LENGTH = 2048
END_ID = 1
#: Documents whose ids a task holds at once.
BATCH_ROWS = 1000
#: Pieces of one length in a bucket within which ranks are counted.
BUCKET_ROWS = 2_000
PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


def _cut(path: str, length: int, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        words, end, step = token_ids.encoder(path), np.array([end_id], "<u4").tobytes(), 4 * length
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for whole, row in ((b, i) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)):
            batch = whole.slice(row, BATCH_ROWS)
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids = words.text(text) + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    for column, value in zip(out, (doc, at // 4, len(piece) // 4, len(ids) // 4, piece), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def cut(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``length`` ids, which are little-endian unsigned 32-bit integers in ``ids``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_cut(tokenizer or token_ids.default_path(), length, end_id), PIECE)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths in a pack) for all pieces of ``histogram``, by shortest-pack-first over it."""
    by_room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(length + 1)]
    most = 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left > 0:
            while most > 0 and not by_room[most]:
                most -= 1
            if most >= size:
                # the shortest packs are those with the most room
                count, pack = by_room[most].pop()
                n = min(count, left)
                if count > n:
                    by_room[most].append((count - n, pack))
                by_room[most - size].append((n, (*pack, size)))
                left -= n
                continue
            # none has room: open packs, each filled with this size before the next is opened
            fit = length // size
            for n, times in ((left // fit, fit), (1, left % fit)):
                if n and times:
                    by_room[length - times * size].append((n, (size,) * times))
                    most = max(most, length - times * size)
            left = 0
    return [x for room in by_room for x in room]


def place(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces``, a stored table with a ``length`` column, with sequence_id and offset for each row.

    Rows are ranked by all columns that the table has but ``ids``.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for count, pack in patterns(histogram, length):
        offset = 0
        for size in pack:
            slots.append((size, ranks[size], ranks[size] + count, sequence, offset))
            ranks[size] += count
            offset += size
        sequence += count
    slot = spark.createDataFrame(slots, "size bigint, low bigint, high bigint, sequence bigint, offset bigint")

    order = [c for c in pieces.columns if c != "ids"]
    # a row for each length
    shares = spark.createDataFrame([(size, -(-n // BUCKET_ROWS)) for size, n in histogram.items()], "length bigint, buckets bigint")
    keyed = pieces.join(F.broadcast(shares), "length").withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets")))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    counts = counts.select("length", "bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1
    ranked = keyed.withColumn("within", within).join(counts, ["length", "bucket"])
    rank = F.col("before") + F.col("within")
    # a row for each length in each pattern, which the maximum length bounds
    found = ranked.join(broadcast_if_small(slot, 500_000), (F.col("length") == F.col("size")) & (rank >= F.col("low")) & (rank < F.col("high")))
    return found.select(*pieces.columns, (F.col("sequence") + rank - F.col("low")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces of ``docs`` with their ids and places."""
    return place(stored(cut(docs, tokenizer, length), "pieces"), length)


def pack_digests(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """As ``pack``, with a CRC-32 in place of each piece's ids."""
    pieces = cut(docs, tokenizer, length).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(stored(pieces, "pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from the result of ``pack``; a sequence has at most as many pieces as ids."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
