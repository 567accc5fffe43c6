"""Registered queries of the corpus operators: each over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import divergence, licences, mining, mixing, neardup, packing, piecebpe, pii, quality, secrets, suffixtree, toolcalls, vectordup
from foldwise.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return vectordup.near_vectors(table(spark, folder, "embeddings"))


def op4_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    return toolcalls.tool_records(spark, table(spark, folder, "conversations"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(table(spark, folder, "documents"))


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piecebpe.round_trip(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licences(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return suffixtree.scores(table(spark, folder, "documents"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(table(spark, folder, "embeddings").withColumn("label", shifted))


def op13_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_minhash_neardup": op1_minhash_neardup,
    "op2_pii": op2_pii,
    "op3_embedding_neardup": op3_embedding_neardup,
    "op4_tool_calls": op4_tool_calls,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_secrets": op6_secrets,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_licences": op8_licences,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_scores": op10_lm_scores,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_mixing": op13_source_mixing,
}
ORACLES: dict[str, str] = {
    "op4_tool_calls": toolcalls.ORACLE,
    "op8_licences": licences.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_hard_negatives": mining.ORACLE,
    "op13_source_mixing": mixing.ORACLE,
}
