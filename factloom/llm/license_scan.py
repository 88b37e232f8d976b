"""License scans: MinHash bands over windows of a text retrieve templates, exact containment verifies them (operator 1).

All of it is DataFrame functions. Words are runs of a-z and 0-9 after lower
casing; a shingle is SHINGLE words in a row. A template of L shingles is looked
for in windows of w shingles, w the least power of two of 2 L or more, that
start every w / 2, so that a template in one piece lies within one window whole
and is a quarter of it or more. Each of BANDS bands is one minimum: a template
of which a window has four fifths agrees with it in a band with probability
0.19 or more, in none of 64 bands once in 700,000 cases.

A window can agree in a band only if it holds the template's own minimum of
that band. So a text is looked through for these minima first, at most BANDS
for a template however long it is, and only windows that hold one are hashed,
for its band alone: the same retrieval as hashing every window for every band.
What bands retrieve is verified on the words themselves: at least
MIN_CONTAINED of a template's distinct shingles must be in the window. Of
findings that overlap in a text the one with the greatest share stays, then the
one of the longer template; places of a template within one window may count
as one.

Templates are a table of license and text, of thousands of rows at most: their
minima are constants of the plan.

Defined cases: a null, empty or shorter text has no finding; rows that share
doc_id and text give one finding; a null doc_id is kept; an empty table gives
an empty result; only the key and text columns are read, so other columns may
have any names; a template of less than SHINGLE words is never found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, whole_text
from .license_texts import TEMPLATES

SHINGLE = 5
BANDS = 64
MIN_CONTAINED = 0.8


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _each(words: Column, made, empty: str) -> Column:
    """``made`` of every shingle; none of a text with fewer words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
    found = F.when(F.size(words) >= SHINGLE, F.transform(starts, lambda i: made(F.slice(words, i, SHINGLE))))
    return F.coalesce(found, F.array().cast(f"array<{empty}>"))


def hashes(words: Column) -> Column:
    return _each(words, F.xxhash64, "bigint")


def strings(words: Column) -> Column:
    return _each(words, lambda s: F.concat_ws(" ", s), "string")


def known_templates(texts: DataFrame) -> DataFrame:
    """notice (its number), license, shingles as hashes and as distinct strings, and the window's size for each of ``texts`` (notice, license, text)."""
    made = texts.select("notice", "license", let(tokens(F.col("text")), lambda w: F.struct(F.array_distinct(hashes(w)).alias("hashes"), F.array_distinct(strings(w)).alias("parts"))).alias("s"))
    window = F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * F.size("s.parts")))).cast("int")
    return made.filter(F.size("s.parts") > 0).select("notice", "license", "s.*", window.alias("window"))


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "notice int, license string, text string")


def minima(known: DataFrame) -> DataFrame:
    """Of each template and band the shingle with the least hash (mark) and that hash (least)."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform("hashes", lambda x: F.struct(F.xxhash64(x, b).alias("least"), x.alias("mark")))))
    return known.select("notice", "window", F.posexplode(bands).alias("band", "m")).select("notice", "window", "band", "m.least", "m.mark")


def scan(docs: DataFrame, key: str = "doc_id", texts: DataFrame | None = None, min_contained: float = MIN_CONTAINED) -> DataFrame:
    """doc_id, license, notice, its greatest share in one place, the words before the first place, and the number of places."""
    spark = docs.sparkSession
    known = known_templates(texts if texts is not None else built_in(spark))
    bands = minima(known)
    marks = [r["mark"] for r in bands.select("mark").distinct().collect()]  # BANDS a template at most
    marked = (lambda x: x.isin(marks)) if marks else (lambda x: F.lit(False))

    body = whole_text()
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("h"), let(tokens(body), lambda w: F.struct(w.alias("words"), hashes(w).alias("hashes"))).alias("s"))
    # the words and hashes of the few texts with a mark are worked out once more, which is less than to keep those of all
    rows = rows.filter(F.exists("s.hashes", marked)).select("doc_id", "h", "s.*")
    places = F.filter(F.transform("hashes", lambda x, i: F.struct(x.alias("mark"), i.alias("at"))), lambda p: marked(p["mark"]))
    hits = rows.select("doc_id", "h", "words", "hashes", F.inline(places)).join(F.broadcast(bands), "mark")

    step = F.col("window") / 2
    own = (F.floor(F.col("at") / step) * step).cast("int")
    hits = hits.withColumn("start", F.explode(F.array(own, (own - step).cast("int")))).filter("start >= 0")
    least = F.array_min(F.transform(F.slice("hashes", F.col("start") + 1, F.col("window")), lambda x: F.xxhash64(x, F.col("band"))))
    agree = hits.filter(least == F.col("least")).select("doc_id", "h", "notice", "start", F.slice("words", F.col("start") + 1, F.col("window") + SHINGLE - 1).alias("words"))
    agree = agree.dropDuplicates(["doc_id", "h", "notice", "start"])  # of up to BANDS bands

    found = agree.join(F.broadcast(known.select("notice", "license", "parts")), "notice").withColumn("shingles", strings(F.col("words")))
    held = F.filter(F.transform("shingles", lambda s, i: F.when(F.array_contains("parts", s), i)), lambda i: i.isNotNull())
    share = F.size(F.array_intersect("parts", "shingles")) / F.size("parts")
    found = found.withColumn("contained", share).filter(F.col("contained") >= min_contained).withColumn("held", held)
    one = F.struct(
        "contained", F.size("parts").alias("n"), (-F.col("notice")).alias("back"), (-(F.col("start") + F.array_min("held"))).alias("from"), (-(F.col("start") + F.array_max("held") + SHINGLE)).alias("to"), "license"
    )
    every = found.groupBy("doc_id", "h").agg(F.collect_set(one).alias("found"))  # as many as a text has places
    # the fields are in the order by which a finding is better
    beaten = lambda a: F.exists("found", lambda b: (b > a) & (a["from"] > b["to"]) & (b["from"] > a["to"]))
    best = every.select("doc_id", "h", F.inline(F.filter("found", lambda a: ~beaten(a))))
    out = best.groupBy("doc_id", "h", "license", (-F.col("back")).alias("notice")).agg(F.max("contained").alias("contained"), F.min(-F.col("from")).alias("first_word"), F.count(F.lit(1)).alias("n_places"))
    return out.drop("h")
