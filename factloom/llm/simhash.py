"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 9).

A pair of 64-bit fingerprints with at most three differing bits has at most
one of them in one of the two 32-bit halves. So every fingerprint emits, for
either half, all variants of the half within half the radius (one bit, 33 a
half); pairs that share a variant collide, are deduplicated and verified.

Halves that many fingerprints share would give pairs by the square of their
number. There the whole fingerprint emits all 64-bit variants within two bits
instead, marked by their distance: those within one bit of a variant are within
three bits of all that are within two of it, so that each variant needs only
links from its members to one member, and no pair needs verifying. Both ways
find the same components.

Defined cases: a null or empty text has fingerprint zero, which is linked like
any other; a text of one or two words is one shingle; repeated rows each get a
row; a null doc_id never is a component's id unless there is no other; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.components import connected_components

from .common import first_of_repeats, stored, whole_text, with_keys

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints that share a half, above which the 64-bit variants are used.
CROWD = 64


def _fingerprints(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash

    digest, power = xxhash.xxh64_intdigest, np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        out = []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = text.lower().split()  # of bytes: ASCII letters, ASCII white space
            if not words:
                out.append(0)
                continue
            shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) > SHINGLE else [b" ".join(words)]
            hashes = np.array([digest(x, SEED) for x in shingles], dtype="<u8")
            ones = np.zeros(64, dtype=np.int64)
            for at in range(0, len(hashes), 4096):
                bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64)
                ones += bits.sum(axis=0, dtype=np.int64)
            out.append(int(power[ones * 2 > len(hashes)].sum(dtype=np.uint64)))
        signed = pa.array(np.array(out, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), signed], [*(c for c in batch.schema.names if c != "text"), "fingerprint"])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id`` and the 64-bit fingerprint, as a signed long, of every row."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, fingerprint bigint")


def _half(value: Column, half: int) -> Column:
    return F.shiftrightunsigned(value, 32) if half else value.bitwiseAND(F.lit(0xFFFFFFFF))


#: Bits flipped: none or one, and two.
_NEAR = "concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)))"
_FAR = "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
_HALF = "concat(array(0L), transform(sequence(0, 31), i -> shiftleft(1L, i)))"


def _halves(prints: DataFrame) -> DataFrame:
    each = F.array(*(F.struct(F.lit(h).alias("half"), _half(F.col("b"), h).alias("value")) for h in (0, 1)))
    return prints.select("b", F.inline(each))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) that join all of ``prints``, distinct values b, within the radius of each other."""
    halves = _halves(prints)
    crowds = stored(halves.groupBy("half", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("half", "value"), "crowds")
    masks = lambda sql: F.expr(sql)
    variants = halves.select(F.col("b").alias("a"), "half", F.explode(F.transform(masks(_HALF), lambda m: F.col("value").bitwiseXOR(m))).alias("value"))

    sparse = halves.join(crowds, ["half", "value"], "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = variants.join(sparse, ["half", "value"]).filter((F.col("a") != F.col("b")) & near)
    pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    # a crowd's members and all that may lie within the radius of one by the same half
    dense = variants.join(crowds, ["half", "value"], "left_semi").select(F.col("a").alias("b")).distinct()
    at = lambda sql, far: F.transform(masks(sql), lambda m: F.struct(F.col("b").bitwiseXOR(m).alias("variant"), F.lit(far).alias("far")))
    ball = dense.select("b", F.inline(F.concat(at(_NEAR, False), at(_FAR, True))))
    # of a variant's members, at most 2081, one within a bit of it is within the radius of all
    hub = F.min(F.when(~F.col("far"), F.col("b"))).over(Window.partitionBy("variant"))
    stars = ball.select(F.col("b").alias("u"), hub.alias("v")).filter("u <> v").distinct()
    return pairs.union(stars) if crowds.limit(1).count() else pairs


def labelled(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``rows``, a stored table with a fingerprint column, with the fingerprint that names its component."""
    prints = stored(rows.select("fingerprint").distinct(), "prints")
    labels = connected_components(links(prints.select(F.col("fingerprint").alias("b")), crowd))
    named = labels.select(F.col("node").alias("fingerprint"), "component")
    named = stored(prints.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("component")), "components")
    return rows.join(named, "fingerprint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id reachable over links, of every row."""
    found = labelled(stored(fingerprints(docs, key), "fingerprints"), crowd)
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """Of each component the row with the smallest id, in the columns of ``docs``."""
    keyed = with_keys(docs, key)
    texts = keyed.select("k", "h", whole_text(F.col("row.text")).alias("text"))
    found = labelled(stored(texts.mapInArrow(_fingerprints, "k bigint, h bigint, fingerprint bigint"), "fingerprints"), crowd)
    kept = found.groupBy("component").agg(F.min(F.struct("k", "h")).alias("kept")).select("kept.*")
    return first_of_repeats(keyed).join(kept, ["k", "h"]).select("row.*")


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
