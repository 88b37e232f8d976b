"""Hard negatives for embeddings by exact integer scores (operator 11).

Rows are written once, with a number each. Anchors are dealt into groups of
GROUP and all rows into shards of SHARD at most, both by a hash of that number,
so that no vector, label or id that many rows share makes a group or a shard
larger. Each group meets each shard in one task: the rows of a shard are taken
in tiles, a tile of anchors times rows is multiplied by Strassen's recursion on
64-bit integers, and what is best stays in heaps, one for each anchor. Heaps
of different shards merge by rank. A first pass keeps the best rows of the
anchor's label, which set the windows; a second one keeps the best rows of
other labels within each window.

Integer additions are exact, and as they wrap at 64 bits, so are products that
fit in 64 bits although a sum on the way may not.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part; vectors of different lengths are filled up with zeros;
a null id is the least, and never an anchor; rows that repeat are rows of
their own, anchors included; ties go to the smaller id; an empty table, or one
without anchors, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, stored

#: A row is an anchor when its id is divisible by this.
ANCHORS = 50
#: How many positives an anchor has, and how many negatives each of these.
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of its positive's.
LEAST, MOST = 50, 95
#: Anchors of a group and rows of a shard that meet in one task, and rows of a tile.
GROUP, SHARD, TILE = 2048, 131_072, 1024
#: Multiplications with a side of at most so many rows or columns are done directly.
LEAF = 16
#: Stands for a null id.
NO_ID = -(1 << 63)


def strassen(a, b, leaf: int = LEAF):
    """The product of two integer matrices by seven products of halves; odd sides are filled up with a row or column of zeros."""
    import numpy as np

    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * h), dtype=np.int64)
    out[:i, :h], out[:i, h:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :h], out[i:, h:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


class Best:
    """The ``k`` best (score, id) of each of ``n`` anchors so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.n, self.k = n, k
        self.rows, self.scores, self.ids = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(n, np.iinfo(np.int64).min)

    def offer(self, scores, wanted, ids) -> None:
        """``scores`` is a tile of anchors times rows, ``wanted`` says which of it counts."""
        import numpy as np

        wanted = wanted & (scores >= self.floor[:, None])
        if scores.shape[1] > self.k and wanted.sum() > 16 * self.k * self.n:
            held = np.where(wanted, scores, np.iinfo(np.int64).min)
            wanted &= scores >= np.partition(held, -self.k, axis=1)[:, -self.k][:, None]
        at, of = np.nonzero(wanted)
        if not len(at):
            return
        rows, every, names = np.concatenate([self.rows, at]), np.concatenate([self.scores, scores[at, of]]), np.concatenate([self.ids, ids[of]])
        order = np.lexsort((names, ~every, rows))  # ~ turns scores around and can't overflow
        rows = rows[order]
        starts = np.searchsorted(rows, np.arange(self.n))
        place = np.arange(len(rows)) - starts[rows]
        keep = order[place < self.k]
        self.rows, self.scores, self.ids = rows[place < self.k], every[keep], names[keep]
        full = place == self.k - 1
        self.floor[rows[full]] = every[order[full]]


def _matrix(vectors, width: int):
    """An Arrow column of lists as int64 rows of ``width``, short ones filled up with zeros."""
    import numpy as np

    vectors = vectors.combine_chunks()
    size = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = values
    return out


def _tiles(anchors, rows):
    """Scores of all anchors with the rows of a tile, and the tile."""
    import pyarrow.compute as pc

    width = max(pc.max(pc.list_value_length(x["v"])).as_py() for x in (anchors, rows))
    a = _matrix(anchors["v"], width)
    for at in range(0, len(rows), TILE):
        tile = rows.slice(at, TILE)
        yield strassen(a, _matrix(tile["v"], width).T), {c: tile[c].to_numpy() for c in ("row", "k", "label")}


def _positives(k: int):
    def run(anchors, rows):
        import pyarrow as pa

        if not len(anchors) or not len(rows):
            return pa.table({c: pa.array([], pa.int64()) for c in ("row", "k", "score")})
        own, label, best = anchors["row"].to_numpy(), anchors["label"].to_numpy(), Best(len(anchors), k)
        for scores, tile in _tiles(anchors, rows):
            best.offer(scores, (label[:, None] == tile["label"]) & (own[:, None] != tile["row"]), tile["k"])
        return pa.table({"row": own[best.rows], "k": best.ids, "score": best.scores})

    return run


def _negatives(positives: int, k: int):
    def run(anchors, rows):
        import numpy as np
        import pyarrow as pa

        names = ("row", "place", "k", "score")
        if not len(anchors) or not len(rows):
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        own, label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        # a window beyond those that an anchor has is empty
        low, high = np.zeros((len(anchors), positives), np.int64), np.full((len(anchors), positives), -1, np.int64)
        for i, (a, b) in enumerate(zip(anchors["low"].to_pylist(), anchors["high"].to_pylist(), strict=True)):
            low[i, : len(a)], high[i, : len(b)] = a, b
        best = [Best(len(anchors), k) for _ in range(positives)]
        for scores, tile in _tiles(anchors, rows):
            other = label[:, None] != tile["label"]
            for j, heap in enumerate(best):
                heap.offer(scores, other & (scores >= low[:, j, None]) & (scores <= high[:, j, None]), tile["k"])
        parts = [(own[b.rows], np.full(len(b.rows), j), b.ids, b.scores) for j, b in enumerate(best)]
        return pa.table(dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    return run


def prepared(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """row (a number of its own), k, label and v (integers) of the rows that take part, written once."""
    v = column(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(256.0) * x).cast("bigint"))
    some = rows.filter(column(label).isNotNull() & v.isNotNull() & good)
    out = some.select(F.monotonically_increasing_id().alias("row"), F.coalesce(column(key).cast("bigint"), F.lit(NO_ID).cast("bigint")).alias("k"), column(label).cast("bigint").alias("label"), whole.alias("v"))
    return stored(out, "vectors")


def _dealt(df: DataFrame, name: str, parts: int) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))


def _met(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, run, columns: str) -> DataFrame:
    """``run`` on every group of anchors with every shard of rows."""
    spread = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, shards = -(-n_anchors // GROUP), max(-(-n_rows // SHARD), min(spread, -(-n_rows // 512)), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))  # both sides come from one table
    left = _dealt(own, "g", max(groups, 1)).withColumn("s", every(shards))
    right = _dealt(rows, "s", shards).withColumn("g", every(max(groups, 1)))
    return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(run, columns)


def _first(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "k")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(rows: DataFrame, anchor_every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, **names: str) -> DataFrame:
    """A row for each negative of each positive of each anchor, with ranks and scores.

    The windows are bounded by whole numbers: for scores p and n, least*p <= 100*n <= most*p.
    """
    every = prepared(rows, **names)
    anchors = every.filter((F.col("k") % anchor_every == 0) & (F.col("k") != NO_ID))
    n_rows, n_anchors = every.count(), anchors.count()
    found = _met(anchors, every, n_anchors, n_rows, _positives(positives), "row bigint, k bigint, score bigint")
    found = stored(_first(found, ["row"], positives), "positives")
    p = F.col("score")
    # hundredths by quotient and remainder, so that no product leaves 64 bits
    share = lambda h, up: F.expr(f"score div 100 * {h}") + (F.ceil if up else F.floor)((p % 100) * h / F.lit(100.0))
    windows = found.select("row", F.struct("rank", share(least, True).alias("low"), share(most, False).alias("high")).alias("w"))
    windows = windows.groupBy("row").agg(F.sort_array(F.collect_list("w")).alias("w"))  # ``positives`` of a row at most
    bounded = anchors.join(windows, "row").select("row", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    held = _met(bounded, every, n_anchors, n_rows, _negatives(positives, negatives), "row bigint, place bigint, k bigint, score bigint")
    held = _first(held, ["row", "place"], negatives)
    name = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    pairs = found.join(anchors.select("row", F.col("k").alias("anchor_id")), "row")
    pairs = pairs.select("row", (F.col("rank") - 1).cast("bigint").alias("place"), "anchor_id", name("k").alias("positive_id"), F.col("score").alias("positive_score"))
    out = held.select("row", "place", "rank", name("k").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(pairs, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def with_wrong_labels(rows: DataFrame, every: int = 7, labels: int = 10, key: str = "vec_id", label: str = "label") -> DataFrame:
    """The rows whose id is divisible by ``every`` get the next label."""
    return rows.withColumn(label, F.when(F.col(key) % every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label)))
