"""Search and joins over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans import grid
from factloom.plans.storage import stored

#: Queries that meet in one task, and vectors of a block of the similarity join.
BLOCK = 4096
#: Directions onto which vectors are projected to tell which blocks can't meet, and bits of them that name a block at most.
DIRECTIONS, MAX_BITS = 8, 8


def _unit(vectors):
    """An Arrow column of lists of one length as rows of length 1."""
    import numpy as np

    vectors = vectors.combine_chunks()
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _nearest(k: int):
    def run(queries, rows):
        import numpy as np
        import pyarrow as pa

        names = ("query", "id", "similarity")
        if not len(queries) or not len(rows):
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
        ids, q, every, m = queries["id"].to_numpy(), _unit(queries["vector"]), rows["id"].to_numpy(), _unit(rows["vector"])
        best, found = np.full((len(ids), k), -2.0), np.full((len(ids), k), np.iinfo(np.int64).max)
        for at in range(0, len(every), 2048):
            own = every[at : at + 2048]
            sims = np.round(q @ m[at : at + 2048].T, 9)
            sims[own[None, :] == ids[:, None]] = -2.0
            sims, cand = np.hstack([best, sims]), np.hstack([found, np.broadcast_to(own, (len(ids), len(own)))])
            order = np.lexsort((cand, -sims), axis=1)[:, :k]
            best, found = np.take_along_axis(sims, order, 1), np.take_along_axis(cand, order, 1)
        held = best > -2
        return pa.table({"query": np.broadcast_to(ids[:, None], best.shape)[held], "id": found[held], "similarity": best[held]})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 1, floor: float = -1.0) -> DataFrame:
    """query, id and similarity of each query's ``k`` most alike vectors (id, vector) other than itself, above ``floor``.

    Blocks of queries meet shards of vectors in a grid of tasks; each keeps the
    best ``k`` of its queries, and these are merged by rank. Ties go to the
    lower id; vectors have one length; null ones take no part.
    """
    q, v = (grid.numbered(df.select(F.col("id").cast("bigint").alias("id"), "vector").dropna(), "vectors") for df in (queries, vectors))
    found = grid.met(q, v, q.count(), v.count(), _nearest(k), "query bigint, id bigint, similarity double", BLOCK)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") <= k) & (F.col("similarity") >= floor)).drop("_r")


def _directions(width: int):
    """The same orthonormal directions in every task."""
    import numpy as np

    n = min(DIRECTIONS, width)
    return np.linalg.qr(np.random.default_rng(width).standard_normal((width, n)))[0]


def _projected(batches):
    """Vectors with their shadows. Floats stay as they are, half as wide as the doubles of vectors brought to length 1."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        of: list = [None] * batch.num_rows
        vectors = batch.column("vector").to_pylist()
        for width in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == width]
            m = np.array([vectors[i] for i in at], dtype=np.float64)
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            shadows = np.zeros((len(at), DIRECTIONS))
            shadows[:, : min(DIRECTIONS, width)] = m @ _directions(width)
            for i, unit, shadow in zip(at, m, shadows, strict=True):
                of[i] = (unit, shadow)
        given = batch.column("vector")
        sent = given if pa.types.is_float32(given.type.value_type) else pa.array([x[0] for x in of], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind"), sent, pa.array([x[1] for x in of], pa.list_(pa.float64()))], ["id", "kind", "vector", "shadow"])


def _matches(floor: float, links: bool):
    """Pairs of a block with another, or with itself: all of them, or as many as join what they join."""

    def run(a, b):
        import numpy as np
        import pyarrow as pa

        rows: list[tuple] = []
        if len(a) and len(b):
            same = a["block"][0] == b["block"][0]
            ids = np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])
            of = np.concatenate([np.arange(len(a)), np.arange(len(b)) + len(a)])
            left, right = _unit(a["vector"]), _unit(b["vector"])
            for at in range(0, len(left), 512):
                sims = np.round(left[at : at + 512] @ right.T, 9)
                hit = sims >= floor
                if same:
                    hit &= ids[at : at + len(hit), None] < ids[None, len(a) :]
                if not links:
                    i, j = np.nonzero(hit)
                    u, v = ids[at + i], ids[len(a) + j]
                    rows += zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), sims[i, j].tolist(), strict=True)
                    continue
                for i in np.nonzero(hit.any(axis=1))[0]:
                    old = np.unique(of[np.concatenate([[at + i], len(a) + np.nonzero(hit[i])[0]])])
                    if len(old) > 1:  # a group less each time, so fewer links than rows
                        rows += [(int(ids[old[0]]), int(ids[x]), floor) for x in old[1:]]
                        of[np.isin(of, old[1:])] = old[0]
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("u", pa.int64()), ("v", pa.int64()), ("similarity", pa.float64())))})

    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``, of one kind and one length of vectors, about BLOCK rows that lie on the same sides of the directions."""
    bits = min(MAX_BITS, max(0, (rows.count() // BLOCK).bit_length()))
    side = F.concat_ws("", *(F.when(F.get("shadow", F.lit(i)) >= 0, "1").otherwise("0") for i in range(bits))) if bits else F.lit("")
    coded = rows.withColumn("code", F.concat_ws("|", F.coalesce("kind", F.lit("")), F.size("vector").cast("string"), side))
    parts = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).alias("parts"))
    return coded.join(parts, "code").withColumn("block", F.concat_ws("|", "code", F.pmod(F.xxhash64("id"), "parts").cast("string"))).drop("code", "parts")


def _meeting(blocks: DataFrame, floor: float) -> DataFrame:
    """(a, b) of blocks whose kinds agree and whose boxes are near enough to hold a pair; a null kind agrees with any.

    Of two vectors of length 1 with a similarity of ``floor`` the shadows are
    no farther apart than they are, whose square is 2 - 2 * floor.
    """
    ends = [f(F.get("shadow", F.lit(i))).alias(f"{n}{i}") for i in range(DIRECTIONS) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = stored(blocks.groupBy("block", "kind", F.size("vector").alias("width")).agg(*ends), "boxes")
    a, b = (boxes.select(*(F.col(c).alias(f"{side}_{c}") for c in boxes.columns)) for side in "ab")
    salts = 16
    a, b = a.withColumn("salt", F.pmod(F.xxhash64("a_block"), F.lit(salts))), b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"))
    near = sum((gap(i) * gap(i) for i in range(DIRECTIONS)), F.lit(0.0)) <= 2 - 2 * floor + 1e-6
    kinds = F.col("a_kind").isNull() | F.col("b_kind").isNull() | (F.col("a_kind") == F.col("b_kind"))
    return a.join(b, (F.col("a_width") == F.col("b_width")) & (a["salt"] == b["salt"]) & (F.col("a_block") <= F.col("b_block")) & kinds & near).select(F.col("a_block").alias("a"), F.col("b_block").alias("b"))


def alike(rows: DataFrame, floor: float, links: bool = False) -> DataFrame:
    """u < v and similarity of all pairs of vectors (id, kind, vector) with a cosine of ``floor`` or more and kinds that agree.

    With ``links`` only as many pairs as join the same vectors into groups,
    fewer than there are vectors for each two blocks, however many are alike.
    Equal vectors of a kind are compared as one and linked to the least of them
    in either form. Every pair of blocks that may hold a pair is compared, so
    nothing is missed. A null kind agrees with any; an empty one reads as null;
    null, empty, zero and non-finite vectors are like none, and so are vectors
    of different lengths.
    """
    width = "float" if dict(rows.dtypes)["vector"] == "array<float>" else "double"
    v = F.col("vector").cast(f"array<{width}>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    given = rows.select(F.col("id").cast("bigint").alias("id"), F.when(F.col("kind") != "", F.col("kind")).alias("kind"), v.alias("vector")).filter(fit & F.col("id").isNotNull())
    given = stored(given, "vectors")
    one = given.groupBy("kind", "vector").agg(F.min("id").alias("id"))
    copies = given.join(one.withColumnRenamed("id", "u"), given["vector"].eqNullSafe(one["vector"]) & given["kind"].eqNullSafe(one["kind"])).select("u", F.col("id").alias("v"), F.lit(1.0).alias("similarity")).filter("u < v").distinct()
    blocks = stored(_blocks(one.select("id", "kind", "vector").mapInArrow(_projected, f"id bigint, kind string, vector array<{width}>, shadow array<double>")), "blocks")
    pairs = stored(_meeting(blocks, floor), "meeting")
    held = blocks.select("block", "id", "vector")
    a = held.join(pairs, F.col("block") == F.col("a"))
    b = held.select(*(F.col(c).alias(c) for c in held.columns)).join(pairs.select(F.col("a").alias("a"), F.col("b").alias("b")), F.col("block") == F.col("b"))
    return a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(_matches(floor, links), "u bigint, v bigint, similarity double").filter("u <> v").union(copies)

