"""Claims, their judgments, and the prompts and answers around questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import answers as A
from factloom.functions import text as T


def buckets(claims: DataFrame, sample: str, concept: str, text: str) -> DataFrame:
    """Claims of a sample by concept, in the order of their texts. A sample has as many claims as its turns gave."""
    return claims.groupBy(sample, T.normalize_keyword(concept).alias("concept")).agg(F.sort_array(F.collect_list(text)).alias("claims"), F.count(F.lit(1)).alias("n_claims"))


def judged(bucketed: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Each claim of a bucket with the verdict at its place in the judge's output (verdicts); unverifiable without one."""
    claims = bucketed.select(*keys, F.posexplode("claims").alias("place", "claim"))
    verdicts = outputs.select(*keys, F.posexplode("verdicts").alias("place", "verdict"))
    word = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    out = claims.join(verdicts, [*keys, "place"], "left").withColumn("verdict", F.when(word.isin("supported", "refuted"), word).otherwise("unverifiable"))
    return out.withColumn("score", A.verdict_score("verdict"))


def choice_prompt(question, options: Column) -> Column:
    """A question with its options lettered, a line each."""
    lines = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    return F.concat_ws("\n", F.concat(F.lit("Question: "), T.normalize_text(question)), F.array_join(lines, "\n"))


def scored_choices(samples: DataFrame, answers: DataFrame, key: str, keep_missing: bool = True) -> DataFrame:
    """``samples`` (key, options, expected) joined to ``answers`` (key, answer): picked, score and error.

    Samples without an answer score 0 with an error, or leave when not ``keep_missing``.
    """
    both = samples.join(answers.select(key, "answer"), key, "left" if keep_missing else "inner")
    picked = A.choice_index("answer", F.col("options"))
    error = F.when(F.col("answer").isNull(), "missing_answer").when(picked < 0, "unparseable_answer").when(F.col("expected") < 0, "no_correct_option").otherwise("")
    return both.withColumns({"picked": picked, "error": error}).withColumn("score", F.when((F.col("error") == "") & (F.col("picked") == F.col("expected")), 1.0).otherwise(0.0))


def repaired(claims: DataFrame, judgments: DataFrame, key: str = "claim_id") -> DataFrame:
    """Claims with their judgment and what to do about it: repair what is refuted, check what can't be verified, keep the rest."""
    action = F.when(F.col("verdict") == "refuted", "repair").when(F.coalesce(F.col("verdict") == "supported", F.lit(False)), "keep").otherwise("check")
    return claims.join(judgments.select(key, "verdict"), key, "left").withColumn("action", action)


def summary(judgments: DataFrame, key: str) -> DataFrame:
    """By key: judgments, and how many say yes to a hallucination and to an error of verification."""
    yes = lambda c: F.count_if(F.lower(F.trim(F.coalesce(c, F.lit("")))) == "yes")
    return judgments.groupBy(key).agg(F.count(F.lit(1)).alias("n_judgments"), yes("hallucination").alias("n_hallucination"), yes("verification_error").alias("n_verification_error"))


def ranked(concepts: DataFrame, key: str, wrong: str, turn: str) -> DataFrame:
    """Concepts of a sample numbered: those found wrong first, then by turn, those without one last, then by name."""
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy(F.when(F.col(wrong), 0).otherwise(1), F.col(turn).asc_nulls_last(), "concept")  # as many as a sample has
    return concepts.withColumn("place", F.row_number().over(by))
