"""The wide record frame built from the order tables.

One row per order: bounded right-censored ``score``, a planted-signal target
``y2``, years, categories, numerics with structural NULLs, and a train/test label
whose train share drops in late years.  Derived values are rounded where they
are made, so later thresholds do not depend on the order of a sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import keyed_hash, unit_noise
from ..functions.rowwise import clip
from .tables import read_table

KEY = "row_id"
TARGET = "score"
PLANTED = "y2"
YEARS = ("cohort_year", "ship_year")
CATEGORIES = ("priority", "status", "segment")
NUMERICS = (
    "nation", "acctbal", "n_lines", "avg_qty", "sum_qty", "n_ret", "ret_qty",
    "ext_price", "disc_pts", "tax_pts",
)
#: Columns with structural NULLs: the return quantity is missing when nothing was
#: returned (constant fill), the others when an order has no lines (median fill).
ZERO_FILL = ("ret_qty",)
MEDIAN_FILL = ("avg_qty", "ext_price", "disc_pts", "tax_pts", "n_lines", "n_ret", "sum_qty")
NULLABLE = ZERO_FILL + MEDIAN_FILL
SCORE_GROUP = ("avg_qty", "ret_qty", "disc_pts", "tax_pts")
MODELS = ("pred_a", "pred_b", "pred_c", "pred_d", "pred_e")
TEXT_MODEL = "pred_e"
LATE_YEAR = 1999

# (slope on the score, offset, noise width, noise seed) of the stand-in models;
# pred_d carries no signal.
STAND_INS = {
    "pred_a": (0.80, 10.0, 10.0, 11),
    "pred_b": (0.70, 16.0, 14.0, 12),
    "pred_c": (0.55, 24.0, 20.0, 13),
    "pred_d": (0.0, 54.0, 30.0, 14),
    "pred_e": (0.85, 6.0, 24.0, 15),
}


def line_summary(spark: SparkSession, folder: str) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    return (
        read_table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").cast("double").alias("n_lines"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.sum(F.when(returned, 1.0).otherwise(0.0)).alias("n_ret"),
            F.round(F.avg(F.when(returned, F.col("l_quantity"))), 4).alias("ret_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("ext_price"),
            F.round(F.avg("l_discount") * 1000.0, 3).alias("disc_pts"),
            F.round(F.avg("l_tax") * 1000.0, 3).alias("tax_pts"),
            F.min(F.year("l_shipdate")).alias("ship_year"),
        )
    )


def score_frame(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    customer = read_table(spark, folder, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"
    )
    year = F.year("o_orderdate")
    train_tenths = F.when(year >= LATE_YEAR, 3).otherwise(7)
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(line_summary(spark, folder), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    planted = (
        F.lit(40.0)
        + 6.0 * F.coalesce("n_lines", F.lit(0.0))
        + 0.3 * F.coalesce("avg_qty", F.lit(0.0))
        + 10.0 * unit_noise("o_orderkey", 77)
    )
    return joined.select(
        F.col("o_orderkey").alias(KEY),
        F.when(keyed_hash("o_orderkey", 5) % 10 < train_tenths, "train").otherwise("test").alias("split"),
        year.alias("cohort_year"),
        "ship_year",
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("double").alias("nation"),
        F.col("c_acctbal").alias("acctbal"),
        "n_lines", "avg_qty", "sum_qty", "n_ret", "ret_qty", "ext_price", "disc_pts", "tax_pts",
        F.round(F.least(F.col("o_totalprice") / 4600.0, F.lit(100.0)), 2).alias(TARGET),
        F.round(clip(planted), 2).alias(PLANTED),
    )


def train_rows(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col("split") == "train")


def test_rows(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col("split") == "test")


def prediction_frame(frame: DataFrame) -> DataFrame:
    """Wide predictions of the stand-in models next to the target (both splits)."""
    preds = [
        F.round(clip(F.lit(a) * F.col(TARGET) + F.lit(b) + F.lit(w) * unit_noise(KEY, s)), 4).alias(m)
        for m, (a, b, w, s) in STAND_INS.items()
    ]
    cap = F.round(
        clip((F.col(TARGET) - 90.0) / 12.0 + 0.25 * unit_noise(KEY, 16), 0.0, 1.0), 6
    )
    return frame.select(
        KEY, "split", "cohort_year", "segment", "status", TARGET, *preds, cap.alias("p_cap")
    )


def predictions_long(frame: DataFrame, models=MODELS) -> DataFrame:
    """The keyed prediction store layout: (model, split, row_id, pred)."""
    wide = prediction_frame(frame)
    return wide.unpivot([KEY, "split"], list(models), "model", "pred").select(
        "model", "split", KEY, "pred"
    )


def text_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as scored texts: the length gives a bounded, capped target."""
    docs = read_table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias(KEY),
        F.when(keyed_hash("doc_id", 5) % 10 < 7, "train").otherwise("test").alias("split"),
        "text", "lang", "source",
        F.round(F.least(F.col("n_chars") / 20.0, F.lit(100.0)), 2).alias(TARGET),
    )


def text_structure(df: DataFrame) -> DataFrame:
    """Structured columns of the text frame: language, source, and shares that do not tell the length."""
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda pattern: F.round(F.regexp_count("text", F.lit(pattern)) / n, 6)
    return df.select(
        KEY, "split", "lang", "source", TARGET,
        share("[0-9]").alias("digit_share"), share("[A-Z]").alias("upper_share"), share(r"\p{Punct}").alias("mark_share"),
        share(r"\s+").alias("gap_share"), share(r"\n").alias("line_share"),
    )


def embedding_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with a bounded target derived from their class label."""
    emb = read_table(spark, folder, "embeddings")
    return emb.select(
        F.col("vec_id").alias(KEY),
        F.when(keyed_hash("vec_id", 5) % 10 < 7, "train").otherwise("test").alias("split"),
        "embedding", "label",
        F.round(clip(F.col("label") * 10.0 + 5.0 * unit_noise("vec_id", 9)), 2).alias(TARGET),
    )
