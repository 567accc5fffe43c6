"""Table readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def strip_bom(df: DataFrame) -> DataFrame:
    """Drop a byte-order mark from the header names."""
    return df.toDF(*[c.replace(BOM, "") for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere: NaN would sort above all numbers and poison averages."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns]
    )


def read_wide_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Wide CSV with a header (UTF-8, optional byte-order mark) and a fixed schema."""
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return nan_to_null(strip_bom(raw))
