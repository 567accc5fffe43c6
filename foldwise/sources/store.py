"""Keyed prediction store, upsert ledgers and published files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str) -> None:
    """Write (model, split, row_id, pred); only the models in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def read_predictions(spark: SparkSession, path: str, models: Sequence[str] | None = None) -> DataFrame:
    """Read the store; a model list prunes partitions."""
    df = spark.read.parquet(path)
    return df if models is None else df.filter(F.col("model").isin(list(models)))


def available_models(store: DataFrame) -> DataFrame:
    """Models with predictions on both sides."""
    return store.groupBy("model").agg(F.countDistinct("split").alias("sides")).filter("sides = 2").select("model")


def prediction_matrix(store: DataFrame, models: Sequence[str], split: str, key: str = "row_id") -> DataFrame:
    """One row per key, one column per model; models missing on one side are skipped."""
    usable = store.join(F.broadcast(available_models(store)), "model", "left_semi").filter(F.col("split") == split)
    return usable.groupBy(key).pivot("model", list(models)).agg(F.first("pred"))


def intake_report(df: DataFrame, key: str, pred: str, expected_rows: Column, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Checks an external prediction must pass before it is stored."""
    p = F.col(pred)
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    report = df.agg(
        F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.sum(bad.cast("long")).alias("n_not_finite"),
        F.sum(F.coalesce((p < lo - 1e-9) | (p > hi + 1e-9), F.lit(False)).cast("long")).alias("n_out_of_range"))
    ok = (F.col("n_rows") == F.col("n_keys")) & (F.col("n_rows") == F.col("expected")) & (F.col("n_not_finite") == 0) & (F.col("n_out_of_range") == 0)
    return report.select("*", expected_rows.alias("expected")).withColumn("accepted", ok)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace rows with the new keys, widen the schema where needed."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def detail_rows(cells: DataFrame, groups: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """Ledger rows holding their per-cell values as one ordered list (and its JSON text)."""
    ordered = F.array_sort(F.collect_list(F.struct("repeat", "fold", F.round(value, digits).alias("v"))))
    out = cells.groupBy(*groups).agg(F.transform(ordered, lambda s: s["v"]).alias("values"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.withColumn("json", F.to_json("values"))


def write_report(df: DataFrame, path: str) -> None:
    """Small report table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_submission(df: DataFrame, path: str, order: str, columns: Sequence[str], single: bool = False) -> None:
    """Ordered CSV: range-partitioned parts, sorted, so that part names follow the order; one part only on request."""
    placed = df.coalesce(1) if single else df.repartitionByRange(order)
    placed.sortWithinPartitions(order).select(*columns).write.mode("overwrite").option("header", True).csv(path)
