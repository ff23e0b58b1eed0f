"""The registered queries of the operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm import bpe, chat, decontaminate, divergence, line_dedup, merkle, near_dup, quality_rules, site_quality, suffix_dedup, token_count, toxicity, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, folder, "pages"))


def op4_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicate_digests(table(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_digests(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.chat_digests(table(spark, folder, "conversations"))


def op10_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    return site_quality.site_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(table(spark, folder, "documents"), vocabulary_path())


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, folder, "documents"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest_digests(table(spark, folder, "documents"))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, folder, "documents"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.token_counts(table(spark, folder, "documents"), vocabulary_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_quality_rules, op3_warc, op4_near_dup, op5_toxicity, op6_decontaminate, op7_chat_format, op8_bpe,
        op9_line_dedup, op10_site_quality, op11_merkle, op12_divergence, op13_token_counts,
    )
}
ORACLES: dict[str, str] = {
    "op3_warc": warc.ORACLE, "op7_chat_format": chat.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_merkle": merkle.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
