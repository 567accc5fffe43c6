"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.session import shared_dir

#: ASCII white space that separates words.
GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tables of row ids up to this many rows (16 bytes each) may be broadcast.
SMALL_IDS = 500_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back.

    Cuts lineage: a lost executor costs only the tasks of the current step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables whose successors are written, so the shared folder holds only live ones."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def hinted(ids: DataFrame, most: int = SMALL_IDS) -> DataFrame:
    """Hint a broadcast of a stored id table only if its counted rows are few; else a shuffle join."""
    return F.broadcast(ids) if ids.count() <= most else ids


def quoted(names: list[str]) -> list[str]:
    """Column names of the caller, safe whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def plain_text(c: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_array(text: Column) -> Column:
    """Words of a text as an array, by built-in functions."""
    return F.filter(F.split(text, GAP), lambda w: w != F.lit(""))


def add_up(items: Column, value: Callable[[Column], Column], kind: str = "long") -> Column:
    return F.aggregate(items, F.lit(0).cast(kind), lambda a, x: a + value(x).cast(kind))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
