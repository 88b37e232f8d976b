"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, decontaminate, dialogues, license_scan, line_chunks, mixing, negatives, packing, ppm, quality, secrets, simhash, sql, token_files
from .common import table


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(F.round(c, 6).alias(c) for c in ("rate_short", "rate_repeats", "rate_any")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.deduped(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(table(spark, sf_dir, "documents"))


def op6_chroma_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.search(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits(out.fingerprint).alias("fingerprint"), "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.with_wrong_labels(table(spark, sf_dir, "embeddings")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return dialogues.audited(dialogues.damaged(turns), turns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_secret_scan": op5_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op1_license_scan": op1_license_scan,
    "op6_chroma_search": op6_chroma_search,
    "op2_ppm_score": op2_ppm_score,
    "op4_line_dedup": op4_line_dedup,
    "op3_packing": op3_packing,
    "op7_mixing": op7_mixing,
    "op9_simhash": op9_simhash,
    "op10_token_files": op10_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_decontamination": op12_decontamination,
    "op13_dialogue_repair": op13_dialogue_repair,
}

SQL: dict[str, str] = {"op1_license_scan": sql.OP1, "op5_secret_scan": sql.OP5, "op8_quality_rules": sql.OP8, "op11_hard_negatives": sql.OP11, "op12_decontamination": sql.OP12}
