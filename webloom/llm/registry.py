"""The queries of the training-data operators and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import attention_mil, capture_index, circulant_minhash, fertility, fm_index, licenses, packing, role_repair, token_counts, url_globs
from webloom.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_mil.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scans(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"))


def op6_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index.indexed(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.removals(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.formatted(table(spark, sf_dir, "conversations"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.groups(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_globs.judged(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_quality_classifier, op3_token_counts, op4_license_scans, op5_quality_rules, op6_capture_index, op7_decontamination, op8_chat_formatting, op9_minhash_dedup, op10_url_filters)}
ORACLES: dict[str, str] = {"op4_license_scans": licenses.oracle(), "op6_capture_index": capture_index.oracle(), "op10_url_filters": url_globs.oracle()}
