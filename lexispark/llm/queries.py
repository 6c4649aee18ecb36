"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


from lexispark.llm import exact_dedup as dedup
from lexispark.llm import collocations, decontaminate, langid, merkle, mixing, ngram_join, page_text, quality, secrets, simhash, substring_dedup, token_output


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(spark, sf_dir)


def op4_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.query(spark, sf_dir)


def op5_chain_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(spark, sf_dir)


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
  text_sha256
FROM t
"""


def op2_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.query(spark, sf_dir)


def op3_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.query(spark, sf_dir)


def op7_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.query(spark, sf_dir)


def op8_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(spark, sf_dir)


def op9_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(spark, sf_dir)


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(spark, sf_dir)


def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(spark, sf_dir)


def op12_prefix_free_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.query(spark, sf_dir)


def op13_postorder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.query(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_poisson_mix, op2_suffix_trees, op3_tag_paths, op4_vertical_jaccard, op5_chain_langid, op6_stream_dedup, op7_range_coder, op8_pairwise_quality, op9_secret_cnn, op10_suffix_automaton, op11_simhash_trie, op12_prefix_free_phrases, op13_postorder_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op1_poisson_mix": mixing.ORACLE, "op6_stream_dedup": OP6_SQL, "op12_prefix_free_phrases": collocations.ORACLE, "op13_postorder_manifest": merkle.ORACLE, "op2_suffix_trees": substring_dedup.ORACLE, "op4_vertical_jaccard": ngram_join.ORACLE, "op10_suffix_automaton": decontaminate.ORACLE}
