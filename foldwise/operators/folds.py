"""Stratified repeated folds and the cell algebra built on them.

A *cell* is a (repeat, fold) pair.  Whatever is fitted for a cell is fitted on the
other folds of the same repeat; additive statistics are summed per cell once and
the training side is ``repeat total - cell``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import PRIME, keyed_hash
from .ranks import bin_of, quantile_edges, row_numbers

SEEDS = (42, 2026, 7)
N_FOLDS = 5
CAP = 100.0
CAP_BIN = 9
CELL = ["repeat", "fold"]


def strat_bins(df: DataFrame, target: str, out: str = "bin", domain=(0.0, 100.0)) -> DataFrame:
    """Rows at the cap form their own bin; the rest is cut into nine equal-frequency bins."""
    edges = quantile_edges(df.filter(F.col(target) < CAP), target, CAP_BIN, domain)
    return df.withColumn(out, F.when(F.col(target) >= CAP, CAP_BIN).otherwise(bin_of(target, edges)).cast("int"))


def assign_folds(
    df: DataFrame, key: str = "row_id", stratum: str | None = "bin",
    seeds: Sequence[int] = SEEDS, n_folds: int = N_FOLDS,
) -> DataFrame:
    """Long fold table (key, repeat, fold): round-robin over a keyed order inside each stratum."""
    repeats = F.array(
        *[F.struct(F.lit(r).alias("repeat"), keyed_hash(key, s).alias("h")) for r, s in enumerate(seeds)]
    )
    level = F.lit(0) if stratum is None else F.col(stratum)
    long = df.select(F.col(key), level.alias("_stratum"), F.explode(repeats).alias("z")).select(
        key, "_stratum", "z.repeat", "z.h"
    )
    numbered = row_numbers(long, ["repeat", "_stratum"], "h", key, (0, PRIME))
    return numbered.select(key, "repeat", ((F.col("rn") - 1) % n_folds).cast("int").alias("fold"))


def stratified_folds(df: DataFrame, target: str, key: str = "row_id", seeds=SEEDS, n_folds=N_FOLDS) -> DataFrame:
    return assign_folds(strat_bins(df.select(key, target), target), key, "bin", seeds, n_folds)


def fold_array(folds: DataFrame, key: str = "row_id", out: str = "folds") -> DataFrame:
    """One row per key with its fold numbers ordered by repeat."""
    return folds.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("repeat", "fold"))), lambda s: s["fold"]).alias(out)
    )


def with_cells(df: DataFrame, folds: DataFrame, key: str = "row_id") -> DataFrame:
    """Attach the long fold table by key."""
    return df.join(folds, key)


def fold_lookup(df: DataFrame, folds: DataFrame, repeat: int, key: str = "row_id") -> DataFrame:
    return df.join(folds.filter(F.col("repeat") == repeat).select(key, "fold"), key, "left")


def training_side(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Turn per-cell sums into training sums (repeat total minus the cell), by key.

    The input has one row per (repeat, fold, key); a window sees at most one row
    per fold.
    """
    whole = Window.partitionBy("repeat", *keys)
    return df.select(
        *CELL, *keys, *[(F.sum(m).over(whole) - F.col(m)).alias(m) for m in measures]
    )


def expand_to_training(df: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """Repeat a (pre-aggregated) cell row for every cell whose training part holds it."""
    others = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: f != F.col("_home"))
    return df.withColumnRenamed("fold", "_home").withColumn("fold", F.explode(others)).drop("_home")


def validate_folds(df: DataFrame, folds: DataFrame, target: str, key: str = "row_id",
                   n_repeats: int = len(SEEDS), tol: float = 0.01) -> DataFrame:
    """Per-cell size and tail shares with a balance flag."""
    y = F.col(target)
    shares = [
        F.avg((y >= CAP).cast("double")).alias("pct_cap"),
        F.avg((y <= 50.0).cast("double")).alias("pct_low"),
    ]
    whole = df.agg(*shares)
    g_cap, g_low = whole.select("pct_cap").scalar(), whole.select("pct_low").scalar()
    cells = with_cells(df.select(key, target), folds, key).groupBy(*CELL).agg(F.count("*").alias("n"), *shares)
    return cells.select(
        *CELL, "n", "pct_cap", "pct_low",
        ((F.abs(F.col("pct_cap") - g_cap) <= tol) & (F.abs(F.col("pct_low") - g_low) <= tol)).alias("balanced"),
    )


def cover_violations(df: DataFrame, folds: DataFrame, key: str = "row_id", n_repeats: int = len(SEEDS)) -> DataFrame:
    """Rows that are missing from a repeat, listed twice, or unknown (must be empty)."""
    seen = folds.groupBy(key).agg(
        F.count("*").alias("n_rows"), F.countDistinct("repeat").alias("n_repeats")
    )
    return (
        df.select(key, F.lit(1).alias("_known"))
        .join(seen, key, "full_outer")
        .filter(
            F.col("_known").isNull()
            | F.coalesce(F.col("n_rows") != n_repeats, F.lit(True))
            | (F.col("n_repeats") != n_repeats)
        )
        .select(key)
    )


def inner_split(key: str | Column, seed: int, repeat: int | Column, n_inner: int = 5) -> Column:
    """Inner fold number inside an outer training part, keyed by row and repeat."""
    if isinstance(repeat, int):
        return (keyed_hash(key, seed + repeat) % n_inner).cast("int")
    arms = F.lit(None).cast("int")
    for r in range(len(SEEDS)):
        arms = F.when(repeat == r, (keyed_hash(key, seed + r) % n_inner).cast("int")).otherwise(arms)
    return arms
