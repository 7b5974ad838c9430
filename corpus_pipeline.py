"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

1. quality       documents that the nearest-neighbour classifier rejects (score under 0.7) go
2. near_copies   of each group of linked documents (3-word shingles, Jaccard 0.9) the smallest doc_id stays
3. contamination documents over the benchmark's coverage limit go; others stay as they are
4. mixing        documents are repeated, or left out, as target weights of their sources ask; every column stays as it is
5. token_files   token ids are written to Arrow files and read back: doc_id, start, n_tokens, ids_crc32

All but the last return the columns of documents. Nulls, empty texts, equal rows and empty tables are
handled as each operator states. The draws of the mix and the fitted classifier have no form in SQL,
so there is no ORACLE_SQL; tests hold each stage against its operator's brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearspark.llm import decontaminate, jaccard_join, knn_quality, mixing, token_files
from clearspark.llm.catalog import tokenizer
from clearspark.llm.common import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return knn_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.op5(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("contamination", contamination),
    ("mixing", mix),
    ("token_files", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage needs only itself goes when its result is written, and so does its input."""
    scratch, before = Scratch(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with Scratch.scope():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
