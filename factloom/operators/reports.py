"""Sliced accuracy and claim reports by grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = (("question_type",), ("tier",), ("corroboration_status",), ("evidence_strength",), ("tier", "question_type"))


def _slices(df: DataFrame, sets, *aggregates) -> DataFrame:
    """Grouping sets () and ``sets``; slice names the columns that a row is grouped by."""
    names = sorted({c for s in sets for c in s})
    columns = [F.col(c) for c in names]
    grouped = df.groupingSets([[], *[[F.col(c) for c in s] for s in sets]], *columns)
    slice_name = F.concat_ws(" x ", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in names))
    return grouped.agg(*aggregates, slice_name.alias("slice"))


def accuracy_report(results: DataFrame, sets=SLICES) -> DataFrame:
    """n, mean and weighted mean score, weight and errors, overall and by each slice."""
    w = F.sum("weight")
    return _slices(
        results, sets, F.count(F.lit(1)).alias("n"), F.avg("score").alias("acc"),
        F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("weight")), w), F.lit(0.0)).alias("weighted_acc"),
        w.alias("total_weight"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )


def claim_metrics(claims: DataFrame, keys=("sample_id",)) -> DataFrame:
    """Per sample: claims by verdict, the refuted share, mean severity, severity by concept weight, and whether any is refuted."""
    w = F.sum("concept_weight")
    n = F.count(F.lit(1))
    return claims.groupBy(*keys).agg(
        n.alias("n_claims"), F.count_if(F.col("verdict") == "refuted").alias("n_refuted"),
        F.count_if(F.col("verdict") == "unverifiable").alias("n_unverifiable"), F.count_if(F.col("verdict") == "supported").alias("n_supported"),
        (F.count_if(F.col("verdict") == "refuted") / n).alias("HR"), F.avg("score").alias("HS"),
        F.when(w > 0, F.sum(F.col("score") * F.col("concept_weight")) / w).otherwise(F.avg("score")).alias("HS_weighted"),
        F.max((F.col("verdict") == "refuted").cast("int")).alias("HF"),
        F.sum(F.col("score") * F.col("concept_weight")).alias("cw_score"), w.alias("cw"),
    )


def audit_report(samples: DataFrame, sets=(("question_type",), ("tier",), ("tier", "question_type"))) -> DataFrame:
    """Means over samples and over claims, overall and by each slice. ``samples``: claim_metrics with the slices' columns."""
    n = F.sum("n_claims")
    per = lambda x: F.coalesce(F.try_divide(F.sum(x), n), F.lit(0.0))
    return _slices(
        samples, sets, F.count(F.lit(1)).alias("n_samples"), n.alias("n_claims"), F.sum("n_refuted").alias("n_refuted"),
        F.avg("HR").alias("HR_macro"), F.avg("HS").alias("HS_macro"), F.avg("HF").alias("HF_rate"),
        per(F.col("n_refuted")).alias("HR_micro"), per(F.col("HS") * F.col("n_claims")).alias("HS_micro"),
        F.coalesce(F.try_divide(F.sum("cw_score"), F.sum("cw")), F.lit(0.0)).alias("HS_weighted_micro"),
    )


def screening(df: DataFrame, score: str, label: str, threshold: float = 0.6, *keys: str) -> DataFrame:
    """Sensitivity, specificity, predictive value and prevalence of a score against 0/1 labels."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    n = lambda c: F.count_if(c)
    over = lambda a, b: a / F.greatest(b.cast("double"), F.lit(1e-8))
    return df.groupBy(*keys).agg(
        over(n(hit & true), n(true)).alias("sensitivity"), over(n(~hit & ~true), n(~true)).alias("specificity"),
        over(n(hit & true), n(hit)).alias("ppv"), over(n(true), F.count(F.lit(1))).alias("prevalence"),
    )


def fold_change(df: DataFrame, value: str, case: str, *keys: str) -> DataFrame:
    """log2 of the mean of rows where ``case`` holds over that of the others, and its direction."""
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col(value))), F.lit(0.0)) + 1e-6
    out = df.groupBy(*keys).agg(F.log2(mean(F.expr(case)) / mean(~F.expr(case))).alias("log2_fold_change"))
    return out.withColumn("direction", F.when(F.col("log2_fold_change") > 0, "up").when(F.col("log2_fold_change") < 0, "down").otherwise("flat"))


def dose_response(df: DataFrame, dose: str, response: str, *keys: str) -> DataFrame:
    """The drop of the response from the least dose to the greatest, and the dose nearest half response."""
    first, last = F.min_by(response, dose), F.max_by(response, dose)
    return df.groupBy(*keys).agg((first - last).alias("activity_drop"), F.min_by(dose, F.struct(F.abs(F.col(response) - 0.5), F.col(dose))).alias("ic50"))


def weighted_signal(df: DataFrame, weight: str, signal: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(signal)) / F.greatest(F.sum(weight), F.lit(1e-8))).alias("score"))
