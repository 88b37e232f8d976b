"""Document quality rules with verdicts per host (operator 8).

All of it is DataFrame functions. A document fails a rule by its own text. For
each rule, and for failing any, the share of a host's documents that fail is
shrunk towards the corpus by a beta prior fitted to all other hosts, so that a
host has no part in what it is judged by. A host is rejected when a shrunk rate
is more than DEVIATIONS above the prior's mean, a deviation being that of the
shrunk rates which hosts of this size would have under the prior, or above
MAX_HOST_RATE however much the hosts differ.

Defined cases: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows each count and each get a verdict; an empty
table gives an empty result; other columns, whatever their names, are kept
by ``judged`` and ignored by ``measure``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, column, let, stored, whole_text, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host is rejected when a shrunk rate is more than so many deviations above the prior's mean, or above this rate.
DEVIATIONS, MAX_HOST_RATE = 4.0, 0.6
#: Bounds of the fitted prior's weight, in documents; the upper one keeps hosts that differ little from others.
MIN_PRIOR, MAX_PRIOR = 2.0, 100.0


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """How many words lie in a run of ``window`` words that the text has twice or more."""

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(
            (p + window).alias("end"), (a["n"] + p + window - F.greatest(p, a["end"])).cast("long").alias("n")
        )
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            h = lambda i: F.get(pairs, i)["h"]
            same = lambda x, i: F.coalesce(x["h"] == h(i), F.lit(False))
            twins = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return covered(F.sort_array(F.transform(twins, lambda x: x["i"])))

        pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(pairs, of_sorted)
        )

    starts = F.sequence(F.lit(1), F.size(tokens) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, window)))
    return F.when(F.size(tokens) <= window, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def measures(text: Column) -> Column:
    """A struct of what the rules look at, for one text without nulls."""

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        )

    return let(words(text), of_words)


def rules() -> dict[str, Column]:
    """What fails a document, by the rule's name."""
    return {"short": F.col("n_words") < MIN_WORDS, "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")}


def host_rules() -> dict[str, Column]:
    """What is looked at by host: each rule, and whether any failed."""
    return rules() | {"any": failed()}


def failed() -> Column:
    return reduce(lambda a, b: a | b, rules().values())


def measure(docs: DataFrame, host: str = "source", key: str = "doc_id") -> DataFrame:
    """key, host and the measures of every row, with ``base_failed``."""
    m = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), measures(whole_text()).alias("m"))
    m = m.select("doc_id", "host", "m.*")
    return m.withColumn("base_failed", failed())


def host_rates(measured: DataFrame) -> DataFrame:
    """One row per host: documents, and failures, shrunk rate and bound (n_, rate_ and most_) of each rule and of any; host_rejected.

    A host's prior is fitted by moments of the other hosts' rates: its mean is
    theirs, one document of theirs at least, and its weight is what the spread
    between them leaves after the spread that counting alone explains. Sums
    over all hosts are one row; each host takes its own part out again.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.count_if(rule).alias(f"n_{name}") for name, rule in host_rules().items()))
    hosts = stored(hosts, "hosts")
    n = F.col("n_docs")
    share = {name: F.col(f"n_{name}") / n for name in host_rules()}
    moments = [f.alias(f"{what}_{name}") for name, x in share.items() for what, f in (("first", F.sum(x)), ("second", F.sum(x * x)))]
    total = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs"), F.sum(1 / n).alias("per_doc"), *moments).first()
    others = max(total["hosts"] - 1, 1)
    left = lambda whole, own: (F.lit(float(whole or 0)) - own) / others if total["hosts"] > 1 else own
    bad = F.lit(False)
    for name, x in share.items():
        raw = left(total[f"first_{name}"], x)
        mean = F.greatest(raw, 1 / (F.lit(total["docs"] or 0) - n + 1)) if total["hosts"] > 1 else raw
        spread = mean * (1 - mean)
        extra = left(total[f"second_{name}"], x * x) - raw * raw - spread * left(total["per_doc"], 1 / n)
        weight = F.when(extra > 0, F.least(F.lit(MAX_PRIOR), F.greatest(F.lit(MIN_PRIOR), spread / extra - 1))).otherwise(MAX_PRIOR)
        hosts = hosts.withColumns({"_mean": mean, "_spread": spread, "_weight": weight})
        rate = (F.col(f"n_{name}") + F.col("_mean") * F.col("_weight")) / (n + F.col("_weight"))
        deviation = F.sqrt(F.col("_spread") / (F.col("_weight") + 1) * n / (n + F.col("_weight")))
        hosts = hosts.withColumns({f"rate_{name}": rate, f"most_{name}": F.least(F.lit(MAX_HOST_RATE), F.col("_mean") + DEVIATIONS * deviation)}).drop("_mean", "_spread", "_weight")
        bad |= F.col(f"rate_{name}") > F.col(f"most_{name}")
    return hosts.withColumn("host_rejected", bad)


def judged(docs: DataFrame, measured: DataFrame, host: str = "host") -> DataFrame:
    """``docs``, which has ``measured``'s columns, with its host's verdict and ``kept``."""
    verdicts = host_rates(measured).select(F.col("host").alias("_h"), *(f"rate_{name}" for name in host_rules()), "host_rejected")
    out = docs.join(broadcast_if_small(verdicts), F.col(host).eqNullSafe(F.col("_h")), "left").drop("_h")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))


def quality_rules(docs: DataFrame, host: str = "source", key: str = "doc_id") -> DataFrame:
    """Measures and verdict for every row of ``docs``."""
    measured = stored(measure(docs, host, key), "quality")
    return judged(measured, measured)


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    row = docs.select(F.struct(*map(column, docs.columns)).alias("row"), F.col(host).alias("host"), measures(whole_text()).alias("m"))
    measured = stored(row.select("row", "host", "m.*").withColumn("base_failed", failed()), "quality")
    return judged(measured, measured.drop("row")).filter("kept").select("row.*")
