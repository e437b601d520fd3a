"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat_format, clustering, decontaminate, divergence, exact_dedup, langid, license_scan, line_dedup, lm_score, packing, quality, simhash_dedup, substring_dedup
from tidemark.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(table(spark, sf_dir, "documents"), license_scan.templates(spark))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_path(spark, f"{sf_dir}/documents.parquet")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_report(table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_report(chat_format.with_conflict(table(spark, sf_dir, "conversations")))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_packing,
        op2_simhash_dedup,
        op3_langid,
        op4_line_dedup,
        op5_license_scan,
        op6_substring_dedup,
        op7_quality,
        op8_decontaminate,
        op9_exact_dedup,
        op10_lm_score,
        op11_clustering,
        op12_chat_format,
        op13_source_audit,
    )
    return {f.__name__: f for f in registered}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": line_dedup.SQL,
        "op5_license_scan": license_scan.SQL,
        "op6_substring_dedup": substring_dedup.SQL,
        "op8_decontaminate": decontaminate.SQL,
        "op9_exact_dedup": exact_dedup.SQL,
        "op11_clustering": clustering.SQL,
        "op12_chat_format": chat_format.SQL,
        "op13_source_audit": divergence.SQL,
    }
