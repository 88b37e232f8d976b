"""Line dedup by rolling hashes over lines (operator 4).

A text's lines are hashed, and a rolling hash over the line hashes is kept of
every WINDOW of lines, at whichever line it starts: so it depends on its lines
alone, and a shared passage has the same hashes wherever it stands and whatever
is around it. A line of LONG_WORDS words or more is kept by itself as well. Of
windows and long lines that the corpus has more than once, the first in order
of doc_id and place stays. The others, as runs of windows that start at
consecutive lines, are removed if the run has MIN_WORDS words or more. A run
thus has two lines or more, or is one long line. Each line that goes has an
equal one that stays: the first place is before all others.

Equal windows are found by hash and compared as bytes: where two different byte
strings meet under a pair of hashes, the first place of each string stays.

Defined cases: a null text stays null; an empty text has one empty line, which
is in no run; an empty line is a line, so that a line and an empty one after it
are a window; rows that share doc_id and text are one place, so that either
keeps what the other keeps; a null doc_id comes first; an empty table gives an
empty result; all columns are kept, whatever their names, with n_chars set to
match where there is one. A text may end empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import broadcast_if_small, column, stored

WINDOW = 2
LONG_WORDS = 50
MIN_WORDS = 10
#: Texts that a task holds as lines at once.
BATCH_ROWS = 1000
_FACTOR = 0x9E3779B97F4A7C15


def places_of(lines: list[bytes]):
    """The place and two hashes of every window and every long line; a window from line i has the place 2 i, a long line 2 i + 1."""
    import numpy as np
    import xxhash

    each = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<u8").reshape(-1, 2)
    n = max(0, len(lines) - WINDOW + 1)
    rolled = np.zeros((n, 2), np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(_FACTOR) + each[k : k + n]
    # so many words have as many bytes and spaces between them
    long = [i for i, line in enumerate(lines) if len(line) >= 2 * LONG_WORDS - 1 and len(line.split()) >= LONG_WORDS]
    at = np.concatenate([2 * np.arange(n), 2 * np.array(long, np.int64) + 1])
    return at, np.concatenate([rolled, each[long]]).view(np.int64)


def _body(lines: list[bytes], at: int) -> bytes:
    return lines[at // 2] if at % 2 else b"\n".join(lines[at // 2 : at // 2 + WINDOW])


def runs_of(lines: list[bytes], places) -> list[tuple[int, int, int]]:
    """(first line, line after the last, words) of each run to remove, by the places of windows and long lines that are repeated."""
    spans: list[list[int]] = []
    for i in sorted(at // 2 for at in places if at % 2 == 0):
        if spans and i <= spans[-1][1] - WINDOW + 1:
            spans[-1][1] = i + WINDOW
        else:
            spans.append([i, i + WINDOW])
    spans += [[at // 2, at // 2 + 1] for at in places if at % 2]
    runs = [(a, b, sum(len(line.split()) for line in lines[a:b])) for a, b in spans]
    return [r for r in runs if r[2] >= MIN_WORDS]


def _slices(batches):
    return (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))


def _lines(batch):
    import pyarrow as pa

    return ((text or b"").split(b"\n") for text in batch.column("text").cast(pa.binary()).to_pylist())


def _places(batches):
    import numpy as np
    import pyarrow as pa

    for batch in _slices(batches):
        each = [places_of(lines) for lines in _lines(batch)]
        row = pa.array(np.repeat(np.arange(len(each)), [len(at) for at, _ in each]))
        at, hashes = np.concatenate([at for at, _ in each]), np.concatenate([h for _, h in each])
        columns = [batch.column("doc_id").take(row), batch.column("h").take(row), pa.array(at), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "at", "hash", "check"])


BODY = "doc_id bigint, h bigint, at bigint, hash bigint, check bigint, body binary"


def _bodies(batches):
    import pyarrow as pa

    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "h", "at", "hash", "check")), ("body", pa.binary())])
    for batch in _slices(batches):
        out, held = [], 0
        for doc, h, lines, places in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), _lines(batch), batch.column("places").to_pylist(), strict=True):
            for place in places or ():
                out.append(place | {"doc_id": doc, "h": h, "body": _body(lines, place["at"])})
                held += len(out[-1]["body"])
            if held > 8_000_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)


def _cut(batches):
    import pyarrow as pa

    for batch in _slices(batches):
        texts, counts = [], []
        for text, lines, removed in zip(batch.column("text").cast(pa.binary()).to_pylist(), _lines(batch), batch.column("removed").to_pylist(), strict=True):
            runs = runs_of(lines, removed or ())
            gone = {i for a, b, _ in runs for i in range(a, b)}
            texts.append(b"\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text)
            counts.append((len(lines), len(gone), len(runs)))
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), *columns], ["row", "text", "n_lines", "n_removed_lines", "n_removed_chunks"])


def repeated(rows: DataFrame) -> DataFrame:
    """doc_id, h, at, hash, check and is_first of each place of ``rows`` (doc_id, h, text) whose hashes another place has too."""
    places = rows.mapInArrow(_places, "doc_id bigint, h bigint, at bigint, hash bigint, check bigint")
    place = F.struct("doc_id", "h", "at")
    each = places.groupBy("hash", "check").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last")
    return places.join(each, ["hash", "check"]).select("doc_id", "h", "at", "hash", "check", place.eqNullSafe(F.col("first")).alias("is_first"))


def deduped(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """row (the columns of ``docs`` but text), text, n_lines, n_removed_lines and n_removed_chunks (runs of lines) for every row."""
    # a struct needs a field; one longer than any other clashes with none
    some = F.lit(True).alias("_" * (1 + max(map(len, docs.columns))))
    rest = F.struct(some, *(column(c) for c in docs.columns if c != "text")).alias("row")
    rows = docs.select(column(key).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"), rest)
    found = stored(repeated(rows.select("doc_id", "h", "text")), "repeated")

    def with_lists(lists: DataFrame, name: str) -> DataFrame:
        lists = lists.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), name)  # at most the places of one text
        return rows.join(lists, rows.doc_id.eqNullSafe(lists.d) & (rows.h == lists.g), "left").select("row", "doc_id", "h", "text", name)

    # both joins shuffle the same rows alike, so that they are shuffled once
    listed = with_lists(found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", "hash", "check")).alias("places")), "places")
    bodies = listed.drop("row").mapInArrow(_bodies, BODY)
    clash = bodies.groupBy("hash", "check").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b").select("hash", "check")
    clash = broadcast_if_small(stored(clash, "clashes"))
    again = found.filter("not is_first").join(clash, ["hash", "check"], "left_anti").select("doc_id", "h", "at")
    if clash.limit(1).count():
        # different bytes under one pair of hashes: places are told apart by the bytes
        place = F.struct("doc_id", "h", "at")
        each = bodies.join(clash, ["hash", "check"], "left_semi").select("doc_id", "h", "at", "body").distinct()
        first = each.groupBy("body").agg(F.min(place).alias("first"))
        again = again.union(each.join(first, "body").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "h", "at"))
    both = with_lists(again.groupBy("doc_id", "h").agg(F.collect_set("at").alias("removed")), "removed")
    schema = StructType([rows.schema["row"], rows.schema["text"], *(StructField(c, LongType()) for c in ("n_lines", "n_removed_lines", "n_removed_chunks"))])
    return both.select("row", "text", "removed").mapInArrow(_cut, schema)


def dedup_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without repeated chunks, in the same columns."""
    made = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("bigint"), F.lit(0))}
    return deduped(docs, key).select(*((made[c] if c in made else column(c, "row")).alias(c) for c in docs.columns))
