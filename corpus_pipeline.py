"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Documents that score low for quality go; of each component of near duplicates the least
id stays; contaminated documents go; sources are brought to their target weights by
replication, in globally shuffled order; and what is left is written as token ids in that
order, of which the last stage returns the index that it has read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import decontaminate, mixing, ngram_join, quality, token_output
from lexispark.llm.scratch import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, mixing.MIX, 1.0, mixing.MIX_TOTAL, mixing.MIX_SEED).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_index(docs, by_id=False, lanes=768, kept_bytes=16 << 20)  # smaller segments and fewer pieces kept: the stages before have filled the executors


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL cannot express the learned scores and the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
