"""Passages of a benchmark in documents, by winnowing (operator 12).

All of it is DataFrame functions. A window is ``window`` words of an item in a
row, or all words of a shorter item. Of the hashes of the grams in a window the
least is its fingerprint, and so every window that a document shares with an
item has the same fingerprint in both. A document keeps one fingerprint for
each run of windows that have it, which is about one for three words. They are
joined with the items' fingerprints; the windows of a run that meets one are
extended to their words, and these are joined with the items' windows word for
word. So nothing is found that isn't there, and no shared window is lost.

Items shorter than a window are windows of their own length, with grams of half
of it; documents are winnowed once for each length that items have, of which
there are ``window`` at most.

Defined cases: a null or empty text has no words, is in no result of an item,
and gives a row of zeros as a document; a null item id reads as empty; items
that share an id count once; rows that repeat each get a row; an empty
benchmark leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, column, let, stored, whole_text

#: Words of a window.
WINDOW = 10
#: What is between words, once A-Z are small.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN), "")


def _gram(length: int) -> int:
    """Words of the grams that windows of ``length`` words are made of."""
    return (length + 1) // 2


def _grams(ws: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, k)))


def _runs(ws: Column, length: int) -> Column:
    """(fp, at, n) of each run of ``n`` windows from word ``at`` (from 1) that have one fingerprint."""
    k = _gram(length)
    many = length - k + 1  # grams of a window

    def of_minima(least: Column) -> Column:
        starts = F.filter(F.transform(least, lambda x, i: F.struct(x.alias("fp"), (i + 1).alias("at"))), lambda s: (s["at"] == 1) | (s["fp"] != F.get(least, s["at"] - 2)))
        return let(starts, lambda found: F.transform(found, lambda s, i: F.struct(s["fp"], s["at"], (F.coalesce(F.get(found, i + 1)["at"], F.size(least) + 1) - s["at"]).alias("n"))))

    def of_grams(grams: Column) -> Column:
        least = lambda i: F.least(*(F.get(grams, i + j) for j in range(many))) if many > 1 else F.get(grams, i)
        return let(F.transform(F.sequence(F.lit(0), F.size(grams) - many), least), of_minima)

    return F.when(F.size(ws) >= length, let(_grams(ws, k), of_grams))


def _text(ws: Column, at: Column, length: Column | int) -> Column:
    return F.concat_ws(" ", F.slice(ws, at, length))


def windows(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, g (a window's words, joined by spaces), m (how many they are) and fp of every window of every item, once for each item."""
    ws = items.select(F.coalesce(column(key).cast("string"), F.lit("")).alias("item"), words(whole_text(column(text))).alias("ws")).filter(F.size("ws") > 0)
    ws = ws.withColumn("m", F.least(F.size("ws"), F.lit(window)))
    each = ws.select("item", "m", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("m") + 1), lambda i: F.slice("ws", i, F.col("m")))).alias("w"))
    fp = F.array_min(_grams(F.col("w"), 1))
    for length in range(2, window + 1):
        fp = F.when(F.col("m") == length, F.array_min(_grams(F.col("w"), _gram(length)))).otherwise(fp)
    return stored(each.select("item", F.concat_ws(" ", "w").alias("g"), "m", fp.alias("fp")).distinct(), "windows")


def _item_sets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, one) and (one, item): windows that are in the same items are one set, told apart by two sums of hashes and called by its least window."""
    hashed = lambda seed: F.sum(F.xxhash64("item", F.lit(seed)).cast("decimal(38,0)"))
    of = stored(found.groupBy("g", "m").agg(F.count(F.lit(1)).alias("n"), hashed(1).alias("a"), hashed(2).alias("b")), "sets")
    one = of.groupBy("n", "a", "b").agg(F.min("g").alias("one"))
    return of.join(one, ["n", "a", "b"]).select("g", "one"), one.select(F.col("one").alias("g")).join(found, "g").select(F.col("g").alias("one"), "item")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k and h name a row, but for rows that repeat."""
    every = [column(c) for c in docs.columns]
    return docs.select(F.coalesce(column(key).cast("string"), F.lit("")).alias("k"), F.xxhash64(*every).alias("h"), column(key).alias("_id"), words(whole_text(column(text))).alias("ws"))


def occurrences(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, h, at, m and g of every window of ``found`` in a document; rows that repeat are one."""
    lengths = sorted(r["m"] for r in found.select("m").distinct().collect())  # ``window`` at most
    rows, prints = _keyed(docs, key, text), broadcast_if_small(found.select("m", "fp").distinct())
    if not lengths:
        return docs.sparkSession.createDataFrame([], "k string, h bigint, at int, m int, g string")
    runs = F.array(*(F.struct(F.lit(m).alias("m"), _runs(F.col("ws"), m).alias("runs")) for m in lengths))
    each = rows.select("k", "h", F.inline(let(runs, lambda x: x) if len(lengths) > 1 else runs)).select("k", "h", "m", F.inline("runs"))
    met = each.join(prints, ["m", "fp"], "left_semi").groupBy("k", "h").agg(F.collect_set(F.struct("m", "at", "n")).alias("runs"))
    met = stored(met, "runs")  # runs of one document, no more than it has words
    near = rows.select("k", "h", "ws").join(broadcast_if_small(met), ["k", "h"])
    places = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["at"], r["at"] + r["n"] - 1), lambda i: F.struct(r["m"].alias("m"), i.alias("at")))))
    texts = near.select("k", "h", F.explode(F.transform(places, lambda p: F.struct(p["m"], p["at"], _text(F.col("ws"), p["at"], p["m"]).alias("g")))).alias("p")).select("k", "h", "p.*")
    known = broadcast_if_small(found.select("g", "m").distinct())
    return texts.join(known, ["g", "m"], "left_semi").select("k", "h", "at", "m", "g")


def _covered(places: Column) -> Column:
    """How many words lie in windows that begin at ``at`` and have ``m`` words; places are sorted."""
    zero = F.struct(F.lit(1).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, p: F.struct(F.greatest(a["end"], p["at"] + p["m"]).alias("end"), (a["n"] + F.greatest(F.lit(0), p["at"] + p["m"] - F.greatest(a["end"], p["at"]))).cast("bigint").alias("n"))
    return F.aggregate(places, zero, step, lambda a: a["n"])


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document how many words it has and shares with items, how many items these are, and a digest of their ids."""
    found = windows(items, window)
    hits = stored(occurrences(docs, found, key, text), "hits")
    words_hit = hits.groupBy("k", "h").agg(_covered(F.sort_array(F.collect_set(F.struct("at", "m")))).alias("n_hit"))
    of, sets = _item_sets(found)
    held = hits.select("k", "h", "g").join(broadcast_if_small(of), "g").select("k", "h", "one").distinct()
    held = held.join(broadcast_if_small(sets), "one").groupBy("k", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    verdict = words_hit.join(held, ["k", "h"])
    rows = _keyed(docs, key, text).select("_id", "k", "h", F.size("ws").cast("bigint").alias("n_words"))
    out = rows.join(broadcast_if_small(stored(verdict, "verdicts")), ["k", "h"], "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(F.col("_id").alias(key), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, first word (from 0), words and item of every longest passage that a document shares with an item, windows that meet or overlap taken together."""
    found = windows(items, window)
    hits = occurrences(docs, found, key, text).join(found.select("g", "item"), "g")
    zero = F.array().cast("array<struct<at:int,end:int>>")

    def step(done: Column, p: Column) -> Column:
        last, end = F.element_at(done, -1), p["at"] + p["m"]
        meets = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= p["at"])
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["at"].alias("at"), F.greatest(last["end"], end).alias("end"))))
        return F.when(meets, grown).otherwise(F.concat(done, F.array(F.struct(p["at"].alias("at"), end.alias("end")))))

    merged = hits.groupBy("k", "h", "item").agg(F.aggregate(F.sort_array(F.collect_set(F.struct("at", "m"))), zero, step).alias("spans"))
    names = _keyed(docs, key, text).select("_id", "k", "h").distinct()
    out = merged.join(names, ["k", "h"]).select(F.col("_id").alias(key), "item", F.explode("spans").alias("s"))
    return out.select(key, (F.col("s.at") - 1).alias("first_word"), (F.col("s.end") - F.col("s.at")).alias("n_words"), "item")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with an item, with all their columns."""
    every = [column(c) for c in docs.columns]
    hits = occurrences(docs, windows(items, window), key, text).select("k", "h").distinct()
    row = docs.select(F.struct(*every).alias("row"), F.coalesce(column(key).cast("string"), F.lit("")).alias("k"), F.xxhash64(*every).alias("h"))
    return row.join(broadcast_if_small(stored(hits, "hits")), ["k", "h"], "left_anti").select("row.*")
