"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlight.llm import (
    chat, decontamination, fingerprint, html_text, licenses, line_dedup, ngram_join, packing, periodic_runs,
    resampling, sharding, suffix_dedup, toxicity, twins,
)
from wardlight.llm.tables import load


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_snapshots(load(spark, sf_dir, "conversations"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(load(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(load(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(load(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(load(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(load(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_repeats(load(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(load(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampling_digests(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_licenses": op2_licenses,
    "op3_sharding": op3_sharding,
    "op4_html": op4_html,
    "op5_fingerprints": op5_fingerprints,
    "op6_packing": op6_packing,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_resampling": op12_resampling,
    "op13_line_dedup": op13_line_dedup,
}
SQL: dict[str, str] = {
    "op1_chat": twins.CHAT,
    "op2_licenses": licenses.TWIN,
    "op7_ngram_join": twins.NGRAM_JOIN,
    "op9_suffix_dedup": twins.SUFFIX_DEDUP,
    "op10_decontamination": twins.DECONTAMINATION,
    "op12_resampling": resampling.TWIN,
    "op13_line_dedup": line_dedup.TWIN,
}
