"""The corpus pipeline: quality rules, near-dedup, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps,
with their columns; the last one returns the packing. ``run`` writes every
stage's rows as Parquet to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import neardup, packing, pii, quality
from foldwise.llm.queries import tokenizer_path
from foldwise.llm.common import hinted, quoted, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Rows without an id stay; of rows that repeat the kept id, the one with the smallest text hash stays.
    """
    labels = stored(neardup.near_duplicates(docs), "labels")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    several_ids = stored(labels.where("kept").join(repeated, "doc_id", "left_semi").select("doc_id"), "several")
    others = stored(labels.where("not kept").select("doc_id").unionAll(several_ids), "others")
    columns = quoted(docs.columns)
    # Mostly few ids leave: up to SMALL_IDS of them the texts are not shuffled. An anti join keeps rows without an id.
    once = docs.join(hinted(others), "doc_id", "left_anti").select(columns)
    several = docs.join(hinted(several_ids), "doc_id", "left_semi")
    first = F.min_by(F.struct(*columns), F.struct(F.xxhash64("text"), "text"))
    several = several.groupBy("doc_id").agg(first.alias("row")).select("row.*")
    return once.unionByName(several)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; every document stays."""
    return pii.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of all documents left."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the learned stages; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
