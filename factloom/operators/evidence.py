"""Layers of evidence, caches, proposals and their gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T


def first_layer(rows: DataFrame, key: str, layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """``rows`` with evidence and layer: of each row the first layer that has any. Layers have ``key`` and evidence."""
    out = rows
    for i, (_, layer) in enumerate(layers):
        one = layer.filter(F.coalesce("evidence", F.lit("")) != "").groupBy(F.col(key).alias("_k")).agg(F.min("evidence").alias(f"_e{i}"))
        out = out.join(one, F.col(key) == F.col("_k"), "left").drop("_k")
    name = reduce(lambda c, i: c.when(F.col(f"_e{i}").isNotNull(), layers[i][0]), range(len(layers)), F.when(F.lit(False), F.lit("")))
    return out.select(*rows.columns, F.coalesce(*(F.col(f"_e{i}") for i in range(len(layers))), F.lit("")).alias("evidence"), name.otherwise("none").alias("layer"))


def bundled(parts: list[DataFrame], key: str, most: int) -> DataFrame:
    """Evidence of several sources by key, in the sources' order, without repeats, ``most`` a key."""
    ranked = [p.select(key, "evidence", F.lit(i).alias("source_rank")) for i, p in enumerate(parts)]
    distinct = reduce(DataFrame.unionByName, ranked).groupBy(key, "evidence").agg(F.min("source_rank").alias("source_rank"))
    by = Window.partitionBy(key).orderBy("source_rank", "evidence")
    return distinct.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most)


def cache_split(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with what the cache (key, value) holds for them, and those it lacks, each key once."""
    held = rows.join(cache.select(key, "value"), key)
    missing = rows.join(cache.select(key), key, "left_anti").select(key).distinct()
    return held, missing


def grounded(hits: DataFrame, query: str, source: str, min_hits: int = 2, min_sources: int = 1) -> DataFrame:
    """Queries with enough hits and enough different sources."""
    found = hits.groupBy(query).agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct(source).alias("n_sources"))
    return found.withColumn("is_grounded", (F.col("n_hits") >= min_hits) & (F.col("n_sources") >= min_sources))


def proposals(raw: DataFrame, verdicts: DataFrame, min_evidence: int = 3, min_docs: int = 2) -> DataFrame:
    """Proposals (kind, key) with their evidence, documents and outcome: too_few, what the verdict says, or reject without one."""
    found = raw.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_evidence"), F.countDistinct("doc_id").alias("n_docs"))
    enough = (F.col("n_evidence") >= min_evidence) & (F.col("n_docs") >= min_docs)
    return found.join(verdicts.select("kind", "key", "decision"), ["kind", "key"], "left").withColumn("outcome", F.when(~enough, "too_few").otherwise(F.coalesce("decision", F.lit("reject")))).drop("decision")


def seed_score(term: Column, suffixes: tuple[str, ...] = (), noisy: Column | None = None) -> Column:
    """How good a term is to start from: digits 4, capitals after the first letter 3, / : - + 2, its words from two on (4 at most), a known ending 3, less 6 for a noisy one."""
    words = F.size(F.split(F.trim(term), r"\s+"))
    signs = [(term.rlike("[0-9]"), 4), (F.substring(term, 2, 1 << 30).rlike(r"\p{Lu}"), 3), (term.rlike("[/:+-]"), 2)]
    if suffixes:
        signs.append((F.exists(F.array(*map(F.lit, suffixes)), lambda e: F.endswith(F.lower(term), e)), 3))
    score = sum((F.when(s, n).otherwise(0) for s, n in signs), F.when(words >= 2, F.least(words, F.lit(4))).otherwise(0))
    return score - (F.lit(0) if noisy is None else F.when(noisy, 6).otherwise(0))


def ranked_seeds(items: DataFrame, text: str, most: int, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The ``most`` best names in texts, its limit being the feature: words with capitals or digits, counted once a text; acronyms need two texts.

    In order of score, frequency, fewer words, more letters, then the name.
    """
    pattern = r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9]*[A-Z0-9][A-Za-z0-9-]*|[A-Za-z]+-[0-9A-Za-z-]+|[A-Z][a-z]{4,})(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
    each = items.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)))).alias("term"))
    counted = each.groupBy(T.normalize_keyword("term").alias("key")).agg(F.count(F.lit(1)).alias("frequency"), F.min("term").alias("term"))
    kept = counted.filter(~F.col("term").rlike("^[A-Z]{2,4}$") | (F.col("frequency") >= 2))
    scored = kept.withColumn("score", seed_score(F.col("term"), suffixes, F.col("term").rlike("^[A-Z]{2,4}$")))
    words = F.size(F.split("term", r"\s+"))
    return scored.orderBy(F.desc("score"), F.desc("frequency"), words, F.desc(F.length("term")), "key").limit(most)


def acquired(papers: DataFrame, channels: list[tuple[str, DataFrame]], key: str = "paper_id") -> DataFrame:
    """Papers with the text of the first channel that has one, its name, and whether it is a full text; the abstract is the last resort."""
    found = first_layer(papers, key, [(n, c.withColumnRenamed("text", "evidence")) for n, c in channels])
    abstract = T.normalize_text("abstract")
    none = F.col("layer") == "none"
    source = F.when(~none, F.col("layer")).when(abstract != "", "abstract").otherwise("missing")
    return found.select(*papers.columns, F.when(none, abstract).otherwise(F.col("evidence")).alias("text"), source.alias("text_source"), (~none).alias("has_fulltext"))


def permuted(options: Column, key: Column, salt: str = "") -> Column:
    """Options in an order that depends on the row's key and the salt alone."""
    keyed = F.transform(options, lambda o, i: F.struct(F.sha1(F.concat_ws("|", F.lit(salt), key.cast("string"), i.cast("string"))).alias("k"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def positions(rows: DataFrame, kind: str, options: str, answer: str) -> DataFrame:
    """How often the answer stands at each place, by kind."""
    return rows.groupBy(kind, (F.array_position(F.col(options), F.col(answer)) - 1).alias("position")).agg(F.count(F.lit(1)).alias("n"))
