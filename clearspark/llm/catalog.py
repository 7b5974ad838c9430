"""Queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearspark.llm import (
    decontaminate,
    jaccard_join,
    knn_quality,
    license_scan,
    mixing,
    quality_rules,
    secrets_scan,
    substring_dedup,
    token_counts,
    token_files,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op2(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op3(_table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op4(_table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op5(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.op6(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op7(_table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op8(_table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.op9(_table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op10(_table(spark, sf_dir, "documents"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.target_table(_table(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3(spark, sf_dir).drop("kept", "posterior")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {
    "op1_decontaminate": op1,
    "op2_token_counts": op2,
    "op3_quality_rules": op3,
    "op4_substring_dedup": op4,
    "op5_token_files": op5,
    "op6_knn_quality": op6,
    "op7_license_scan": op7,
    "op8_jaccard_join": op8,
    "op9_secrets_scan": op9,
    "op10_mixing": op10,
    # what of an operator SQL can say, by itself
    "mixing_targets": targets,
    "quality_base": quality_base,
    "secrets_base": secrets_base,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.oracle(),
    "op4_substring_dedup": substring_dedup.oracle(),
    "op7_license_scan": license_scan.oracle(),
    "op8_jaccard_join": jaccard_join.oracle(),
    "mixing_targets": mixing.target_oracle(),
    "quality_base": quality_rules.base_oracle(),
    "secrets_base": secrets_scan.base_oracle(),
}
