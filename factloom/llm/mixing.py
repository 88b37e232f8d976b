"""Mixing sources to target weights (operator 7). All of it is DataFrame functions.

Each source's documents, in a pseudorandom order, are a stream of words that
is cut into blocks of fixed length. A source's target in words makes whole
passes over its blocks and one pass over a part of them, whose last block may
be cut short, so that exactly the target is taken. The mix has a slot for each
block that is taken, SHARD_SLOTS in an output shard. Every slot draws a source
by the share of the sources' blocks, so that a shard's counts by source are a
multinomial draw. Counts over the shards before number a source's slots. Over
all shards the draws miss a source's number of blocks by about its square root:
sources drawn too often give slots that their own permutation chooses to those
drawn too seldom, so that each takes its target exactly. A source's slot finds
its block by a pseudorandom permutation of the block indexes for each source
and pass (swap-or-not: round by round an index and its mirror image change
places or not), and blocks join documents by index.

Sources by code point, null last, weigh 5, 2, 1, repeating. Targets share the
whole size by weight; one that passes MAX_PASSES times its source's size stops
there and the others share the excess by weight.

Defined cases: a null or empty text has no words and nothing is taken of it; a
null source is a source of its own; repeated rows are documents of their own;
an empty table gives an empty result; ``mix_rows`` keeps all columns, whatever
their names, and the rest read doc_id, source and text only. Equal input gives
equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.ranks import running_total

from .common import broadcast_if_small, column, first_of_repeats, let, stored, whole_text, with_keys, words

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 512
SHARD_SLOTS = 1024
SEED = 7
#: Documents of one source in a bucket within which places in the stream are summed.
BUCKET_ROWS = 2_000
#: Slots in a chunk by which slots and sources are joined, and shards in a group by which counts are summed.
CHUNK_SLOTS, GROUP_SHARDS = 1 << 14, 1 << 10
#: Rounds of a permutation.
ROUNDS = 24
#: Slots that a task permutes, and the most tasks that do.
TASK_SLOTS, MAX_TASKS = 1 << 13, 20_000


def sources(rows: DataFrame) -> DataFrame:
    """One row per source: sid, source, source_size, n_docs, weight, target. ``rows`` has source and size."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    named = totals.withColumn("order", F.struct(F.col("source").isNull().alias("last"), "source")).withColumn("one", F.lit(1))
    named = running_total(named, "order", "one", "sid").drop("order", "one")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    # those that stop do so in the order of cap by weight; one stops if its share of what is left at its turn reaches its cap
    turns = named.withColumns({"weight": weight, "cap": MAX_PASSES * F.col("source_size")}).withColumn("turn", F.struct(F.col("cap") / F.col("weight"), "sid"))
    turns = running_total(running_total(turns, "turn", "cap", "caps_before"), "turn", "weight", "weights_before")
    turns = stored(turns.drop("turn"), "turns")
    all_ = turns.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    stops = (all_["size"] - F.col("caps_before")).cast("double") * F.col("weight") >= F.col("cap").cast("double") * (all_["weight"] - F.col("weights_before"))
    left = turns.filter(~stops).agg(F.sum("weight")).first()[0] or 1
    spent = turns.filter(stops).agg(F.sum("cap")).first()[0] or 0
    share = F.lit(float(all_["size"] - spent)) * F.col("weight") / left
    target = F.when(stops, F.col("cap").cast("double")).otherwise(share)
    return turns.select((F.col("sid") + 1).alias("sid"), "source", "source_size", "n_docs", "weight", target.alias("target"))


def placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows``, a stored table with doc_id, source, size and h, with sid and ``at``, the words before it in its source."""
    order = ["doc_id", "size", "h"]
    names = known.select("sid", F.col("source").alias("_s"), "source_size", "target", F.ceil(F.col("n_docs") / BUCKET_ROWS).alias("buckets"))
    keyed = rows.join(broadcast_if_small(names), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.col("buckets"))).drop("buckets")
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    sums = sums.select("sid", "bucket", before.alias("before"))
    within = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return keyed.withColumn("within", within).join(sums, ["sid", "bucket"]).withColumn("at", F.col("before") + F.col("within")).drop("before", "within", "bucket")


def segments(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """sid, block, its part ``off``..``off + n`` that a document fills, the document's ``at`` and the part's start in it."""
    cut = docs.filter("size > 0").select("sid", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    low = F.greatest(F.col("at"), F.col("block") * block)
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("sid", "block", "at", (low - F.col("block") * block).alias("off"), (high - low).alias("n"), (low - F.col("at")).alias("start"))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 to ``n`` - 1, another for each ``key``: swap-or-not, whose rounds are their own inverses."""
    n = F.greatest(n, F.lit(1)).cast("bigint")

    def turn(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, *key), n) - at, n)
        swaps = F.xxhash64(r, F.greatest(at, mirror), F.lit(SEED), *key).bitwiseAND(F.lit(1).cast("bigint")) == 1
        return F.when(swaps, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("bigint"), turn)


def _by_range(rows: DataFrame, at: str, ranges: DataFrame, name: str) -> DataFrame:
    """``rows`` with the row of ``ranges`` whose ``first`` .. ``first`` + ``name`` - 1 holds ``at``; ranges are joined by chunks."""
    last = F.col("first") + F.col(name) - 1
    chunked = ranges.filter(F.col(name) > 0).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / CHUNK_SLOTS), F.floor(last / CHUNK_SLOTS))))
    mine = (F.col(at) >= F.col("first")) & (F.col(at) <= last)
    return rows.withColumn("chunk", F.floor(F.col(at) / CHUNK_SLOTS)).join(broadcast_if_small(chunked), "chunk").filter(mine).drop("chunk")


def draws(known: DataFrame, total: int, seed: int = SEED) -> DataFrame:
    """shard, sid and count: how many of each shard's slots, SHARD_SLOTS but in the last, draw each source of ``known`` (sid, first, n_slots)."""
    slot = known.sparkSession.range(total).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("x"))
    return _by_range(slot, "x", known.select("sid", "first", "n_slots"), "n_slots").groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("count"))


def numbered(counts: DataFrame) -> DataFrame:
    """``counts`` (shard, sid, count) with ``before``, the source's count in the shards before; summed by groups of shards first."""
    grouped = counts.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS))
    sums = grouped.groupBy("sid", "group").agg(F.sum("count").alias("n"))
    earlier = lambda value, w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("sid", "group", earlier("n", Window.partitionBy("sid").orderBy("group")).alias("earlier"))
    within = grouped.withColumn("within", earlier("count", Window.partitionBy("sid", "group").orderBy("shard")))
    return within.join(sums, ["sid", "group"]).select("shard", "sid", "count", (F.col("earlier") + F.col("within")).alias("before"))


def slots(known: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """A row for each block that the mix takes: shard, sid, epoch, block and ``words``, how many of its first words."""
    words_, size = F.col("words"), F.col("source_size")
    each = known.filter("source_size > 0").withColumn("words", F.round("target").cast("bigint"))
    per_pass = F.ceil(size / block)
    n_slots = F.floor(words_ / size) * per_pass + F.ceil((words_ % size) / block)
    each = running_total(each.withColumns({"per_pass": per_pass, "n_slots": n_slots}), "sid", "n_slots", "first")
    each = stored(each.select("sid", "source_size", "words", "per_pass", "n_slots", "first"), "sources")
    total = each.agg(F.sum("n_slots")).first()[0] or 0
    counts = stored(draws(each, total, seed), "draws")
    drawn = counts.groupBy("sid").agg(F.sum("count").alias("drawn"))
    each = each.join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    # places among all slots that were drawn too often, and among all that are wanting
    each = each.withColumns({"over": F.greatest(F.col("drawn") - F.col("n_slots"), F.lit(0)), "wanting": F.greatest(F.col("n_slots") - F.col("drawn"), F.lit(0))})
    each = stored(running_total(running_total(each.drop("first"), "sid", "over", "over_before"), "sid", "wanting", "first"), "sources")
    mine = broadcast_if_small(each.select("sid", "n_slots", "drawn", "over_before"))
    # a row for each shard and source is small, but stands for many slots
    tasks = min(MAX_TASKS, -(-total // TASK_SLOTS) or 1)
    found = numbered(counts).repartition(tasks, "shard", "sid").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1))).join(mine, "sid")
    number = F.col("before") + F.col("i")
    number = F.when(F.col("drawn") > F.col("n_slots"), permuted(number, F.col("drawn"), F.lit(seed), F.col("sid"))).otherwise(number)
    found = found.select("shard", "sid", number.alias("number"), "n_slots", "over_before")
    moved = found.filter("number >= n_slots").select("shard", (F.col("over_before") + F.col("number") - F.col("n_slots")).alias("x"))
    moved = _by_range(moved, "x", each.select("sid", "drawn", "first", "wanting"), "wanting").select("shard", "sid", (F.col("drawn") + F.col("x") - F.col("first")).alias("number"))
    found = found.filter("number < n_slots").select("shard", "sid", "number").union(moved)
    found = found.join(broadcast_if_small(each.select("sid", "source_size", "words", "per_pass")), "sid")
    found = found.select("shard", "sid", "source_size", "words", F.floor(F.col("number") / F.col("per_pass")).alias("epoch"), (F.col("number") % F.col("per_pass")).alias("i"))
    full = F.floor(size / block)
    # the short block at a source's end comes last in each pass
    index = F.when(F.col("i") < full, permuted(F.col("i"), full, F.lit(seed + 1), F.col("sid"), F.col("epoch"))).otherwise(full)
    rest = words_ - F.col("epoch") * size - F.col("i") * block
    return found.select("shard", "sid", "epoch", index.alias("block"), F.least(F.lit(block).cast("bigint"), rest).alias("words"))


def takings(docs: DataFrame, known: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The parts of documents that the mix takes: shard, sid, at, epoch, start and ``taken`` words."""
    found = segments(docs, block).join(slots(known, block), ["sid", "block"])
    taken = F.least(F.col("off") + F.col("n"), F.col("words")) - F.col("off")
    return found.withColumn("taken", taken).filter("taken > 0").select("shard", "sid", "at", "epoch", "start", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs``."""
    text = whole_text()
    rows = docs.select(F.col("doc_id"), F.col("source"), F.size(words(text)).cast("bigint").alias("size"), F.xxhash64(text).alias("h"))
    rows = stored(rows, "sizes")
    known = stored(sources(rows), "targets")
    at = stored(placed(rows, known), "placed")
    taken = takings(at, known).groupBy("sid", "at").agg(F.sum("taken").alias("taken"))
    some = at.filter("size > 0").join(taken, ["sid", "at"], "left")
    none = at.filter("size = 0").withColumn("taken", F.lit(None).cast("bigint"))
    out = some.select(*none.columns).union(none)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: for each pass, the words that it takes of a document, with n_chars to match."""
    keyed = with_keys(docs)
    rows = stored(keyed.select(F.col("k").alias("doc_id"), F.col("row.source").alias("source"), F.size(words(whole_text(F.col("row.text")))).cast("bigint").alias("size"), "h"), "sizes")
    known = stored(sources(rows), "targets")
    at = stored(placed(rows, known), "placed")
    parts = takings(at, known).groupBy("sid", "at", "epoch").agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_list(F.struct("start", "taken"))).alias("parts"))
    parts = at.filter("size > 0").join(parts, ["sid", "at"]).select(F.col("doc_id").alias("k"), "h", "size", "taken", "parts")
    found = first_of_repeats(keyed).join(parts, ["k", "h"])
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(r"([^ \t-\r]+[ \t-\r]*)"))
    some = let(pieces, lambda w: F.concat_ws("", F.transform("parts", lambda p: F.concat_ws("", F.slice(w, (p["start"] + 1).cast("int"), p["taken"].cast("int"))))))
    out = F.when(F.col("taken") == F.col("size"), F.col("row.text")).otherwise(F.regexp_replace(some, r"[ \t-\r]+$", ""))
    found = found.select("row", out.alias("new_text"))
    made = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("bigint")}
    return found.select(*((made[c] if c in made else column(c, "row")).alias(c) for c in docs.columns))
