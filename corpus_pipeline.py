"""A training-corpus pipeline over documents: every stage takes what its predecessor kept and writes what it keeps.

Defined results of all stages: repeated rows are rows of their own; an empty table gives an
empty table; columns beside doc_id, text and source, nulls in them included, pass through all
stages but the last; texts are taken whole, also very long ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusflow.llm import jaccard_join, piece_codec, pii_bootstrap, quality_cascade, queries, source_mixing
from locusflow.llm.common import Scratch

#: SentencePiece ids are the library's: no SQL expresses them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts are rejected."""
    return quality_cascade.judge(docs).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; texts without words are copies of nothing and stay."""
    return jaccard_join.one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; a null text becomes an empty one."""
    return pii_bootstrap.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated to their target weights, in random order; documents without a source are a source of their own."""
    return source_mixing.mix(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, begin and end ids included; a null text has these two alone."""
    return piece_codec.encode_documents(docs.select("doc_id", "source", "text"), queries.model_path(), with_ids=True).drop("text")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing", mixing), ("SentencePiece", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:  # nothing reads a stage's input any more once its output is written
            scratch.drop(before)
        before = docs
    return docs
