"""Encoders and scalers whose statistics are fitted outside the cell they are applied to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup, pin
from .folds import CELL, N_FOLDS, expand_to_training, fold_array, training_side, with_cells
from .ranks import exact_quantiles, sorted_numbers, training_quantiles

MISSING_LEVEL = "nan"


def level_universe(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted levels of each categorical with their position: (column, level, code).

    A missing category is the literal level ``nan``.
    """
    long = train.select(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL)).alias(c) for c in columns])
    levels = long.unpivot([], list(columns), "column", "level").distinct()
    return sorted_numbers(levels, ["level"], ["column"]).select("column", "level", F.col("code").cast("int").alias("code"))


def sparse_one_hot(df: DataFrame, train: DataFrame, columns: Sequence[str], out: str = "onehot") -> tuple[DataFrame, int]:
    """One-hot codes of any number of levels: ``out`` lists the positions of a row's ones; also the width.

    Columns follow one another, levels in sorted order; an unknown level has no position.
    """
    codes = pin(level_universe(train, columns))
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
    width, names = 0, []
    for c in columns:
        table = lookup(codes.filter(F.col("column") == c).select(F.col("level").alias("_lv"), (F.col("code") + width).alias(f"_ix_{c}")))
        df = df.join(table, F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL)) == F.col("_lv"), "left").drop("_lv")
        width, names = width + sizes.get(c, 0), [*names, f"_ix_{c}"]
    return df.withColumn(out, F.array_compact(F.array(*names))).drop(*names), width


def level_list(train: DataFrame, column: str, max_levels: int = 1000) -> list[str]:
    """Driver-side sorted levels of a small categorical; refuses unbounded ones."""
    rows = (
        train.select(F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LEVEL)).alias("level"))
        .distinct().orderBy("level").limit(max_levels + 1).collect()
    )
    if len(rows) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels; use the joined encoders")
    return [r.level for r in rows]


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> list[Column]:
    """0/1 columns for known levels; an unknown level is all zeros."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LEVEL))
    return [(value == F.lit(v)).cast("int").alias(f"{column}_{v}") for v in levels]


def ordinal_codes(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace categories by their training position; unknown becomes -1."""
    codes = level_universe(train, columns)
    for c in columns:
        table = lookup(codes.filter(F.col("column") == c).select(F.col("level").alias("_lv"), F.col("code").alias(f"{c}_code")))
        df = df.join(table, F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL)) == F.col("_lv"), "left").drop("_lv")
        df = df.withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return df


def known_levels_only(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Keep a category only if the training universe holds it, else NULL."""
    table = lookup(train.select(F.col(column).alias("_lv")).distinct())
    return df.join(table, F.col(column) == F.col("_lv"), "left").withColumn(column, F.col("_lv")).drop("_lv")


def cell_medians(df: DataFrame, folds: DataFrame, columns: Sequence[str], key: str = "row_id") -> DataFrame:
    """Exact training medians per (repeat, fold, column)."""
    long = df.select(key, *columns).join(fold_array(folds, key), key).unpivot(["folds"], list(columns), "column", "value")
    return training_quantiles(long, "value", [0.5], ["column"]).withColumnRenamed("q0", "median")


def impute_cells(df: DataFrame, folds: DataFrame, median_cols: Sequence[str], zero_cols: Sequence[str] = (),
                 key: str = "row_id") -> DataFrame:
    """Held-out rows of every cell with gaps filled from that cell's training part."""
    medians = cell_medians(df, folds, median_cols, key)
    wide = F.broadcast(medians.groupBy(*CELL).pivot("column", list(median_cols)).agg(F.first("median")).select(
        *CELL, *[F.col(c).alias(f"_m_{c}") for c in median_cols]))
    keep = [c for c in df.columns if c not in {*median_cols, *zero_cols}]
    return with_cells(df, folds, key).join(wide, CELL).select(
        *CELL, *keep,
        *[F.coalesce(c, f"_m_{c}").alias(c) for c in median_cols],
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in zero_cols],
        *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in [*median_cols, *zero_cols]],
    )


def cell_moments(df: DataFrame, folds: DataFrame, value: str, key: str = "row_id") -> DataFrame:
    """Training mean and population deviation per cell."""
    sums = with_cells(df.select(key, value), folds, key).filter(F.col(value).isNotNull()).groupBy(*CELL).agg(
        F.count("*").cast("double").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    t = training_side(sums, [], ["n", "s", "ss"])
    mean = F.col("s") / F.col("n")
    return t.select(*CELL, mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def scale_cells(df: DataFrame, folds: DataFrame, value: str, out: str, key: str = "row_id") -> DataFrame:
    """Held-out rows standardised with their cell's training moments."""
    stats = F.broadcast(cell_moments(df, folds, value, key))
    scale = F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
    return with_cells(df, folds, key).join(stats, CELL).withColumn(out, (F.col(value) - F.col("mean")) / scale).drop("mean", "std")


def robust_scale(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pooled (median, scale) per column: IQR/1.349, else the deviation, else 1."""
    pooled = train.select(*columns).unionByName(test.select(*columns)).unpivot([], list(columns), "column", "value")
    raw = exact_quantiles(pooled, "value", [0.5], ["column"]).withColumnRenamed("q0", "median")
    filled = pooled.join(F.broadcast(raw), "column").withColumn("value", F.coalesce("value", "median"))
    spread = exact_quantiles(filled, "value", [0.25, 0.75], ["column"])
    dev = filled.groupBy("column").agg(F.stddev_pop("value").alias("dev"))
    iqr = F.col("q1") - F.col("q0")
    return raw.join(spread, "column").join(dev, "column").select(
        "column", "median",
        F.when(iqr > 1e-9, iqr / 1.349).when(F.col("dev") > 1e-9, F.col("dev")).otherwise(F.lit(1.0)).alias("scale"),
    )


def level_sums(df: DataFrame, folds: DataFrame, level: Sequence[str], target: str, key: str = "row_id",
               weight: Column | None = None) -> DataFrame:
    """Count, sum and sum of squares of the target per (cell, level)."""
    w = weight if weight is not None else F.lit(1.0)
    y = F.col(target)
    return with_cells(df, folds, key).groupBy(*CELL, *level).agg(
        F.sum(w).alias("n"), F.sum(w * y).alias("s"), F.sum(w * y * y).alias("ss"))


def _cell_totals(sums: DataFrame) -> DataFrame:
    t = training_side(sums.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]), [], ["n", "s", "ss"])
    return F.broadcast(t.select(*CELL, F.col("n").alias("tn"), F.col("s").alias("ts"), F.col("ss").alias("tss")))


def mean_encoding(df: DataFrame, folds: DataFrame, level: Sequence[str], target: str, smooth: float,
                  key: str = "row_id", weight: Column | None = None) -> DataFrame:
    """(cell, level) -> (s + m * prior) / (n + m), fitted on the cell's training part."""
    sums = level_sums(df, folds, level, target, key, weight)
    fitted = training_side(sums, level, ["n", "s", "ss"]).join(_cell_totals(sums), CELL)
    prior = F.col("ts") / F.col("tn")
    return fitted.select(*CELL, *level, F.col("n"), ((F.col("s") + smooth * prior) / (F.col("n") + smooth)).alias("enc"))


def _auto_smoothed() -> Column:
    prior = F.col("ts") / F.col("tn")
    spread = F.greatest(F.col("tss") / F.col("tn") - prior * prior, F.lit(0.0))
    mean = F.col("s") / F.col("n")
    within = F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))
    lam = spread * F.col("n") / F.nullif(spread * F.col("n") + within, F.lit(0.0))
    return F.when(F.col("n") > 0, F.coalesce(lam, F.lit(1.0)) * mean + (1.0 - F.coalesce(lam, F.lit(1.0))) * prior).otherwise(prior)


def target_encoding(df: DataFrame, folds: DataFrame, level: str, target: str, key: str = "row_id") -> DataFrame:
    """Empirical-Bayes encoding per (cell, level) for the cell's held-out rows."""
    sums = level_sums(df, folds, [level], target, key)
    fitted = training_side(sums, [level], ["n", "s", "ss"]).join(_cell_totals(sums), CELL)
    return fitted.select(*CELL, level, F.when(F.col("n") > 0, F.col("n")).otherwise(0.0).alias("n"), _auto_smoothed().alias("enc"))


def cross_fitted_encoding(df: DataFrame, folds: DataFrame, level: str, target: str, inner: Column,
                          key: str = "row_id", n_inner: int = N_FOLDS) -> DataFrame:
    """(cell, inner, level) encodings for the training rows: both the cell and the inner part are left out."""
    y = F.col(target)
    sums = with_cells(df, folds, key).withColumn("inner", inner).groupBy(*CELL, "inner", level).agg(
        F.count("*").cast("double").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    others = F.filter(F.sequence(F.lit(0), F.lit(n_inner - 1)), lambda i: i != F.col("_in"))
    spread = (
        expand_to_training(sums).withColumnRenamed("inner", "_in").withColumn("inner", F.explode(others))
        .groupBy(*CELL, "inner", level).agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    )
    totals = spread.groupBy(*CELL, "inner").agg(
        F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("ss").alias("tss"))
    return spread.join(F.broadcast(totals), [*CELL, "inner"]).select(*CELL, "inner", level, "n", _auto_smoothed().alias("enc"))


def hierarchical_encoding(df: DataFrame, folds: DataFrame, outer: str, inner: str, target: str, smooth: float = 20.0,
                          key: str = "row_id") -> DataFrame:
    """Two-level shrinkage: (outer, inner) toward outer toward the training mean."""
    fine = level_sums(df, folds, [outer, inner], target, key)
    coarse = fine.groupBy(*CELL, outer).agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    totals = _cell_totals(coarse)
    prior = F.col("ts") / F.col("tn")
    up = training_side(coarse, [outer], ["n", "s"]).join(totals, CELL).select(
        *CELL, outer, ((F.col("s") + smooth * prior) / (F.col("n") + smooth)).alias("up"))
    return training_side(fine, [outer, inner], ["n", "s"]).join(up, [*CELL, outer]).select(
        *CELL, outer, inner, ((F.col("s") + smooth * F.col("up")) / (F.col("n") + smooth)).alias("enc"))


def frequency_encoding(df: DataFrame, folds: DataFrame, level: str, key: str = "row_id") -> DataFrame:
    """(cell, level) -> number of training rows with that level."""
    counts = with_cells(df.select(key, level), folds, key).groupBy(*CELL, level).agg(F.count("*").alias("n"))
    return training_side(counts, [level], ["n"])


def apply_encoding(df: DataFrame, folds: DataFrame, table: DataFrame, level: Sequence[str], out: str,
                   key: str = "row_id") -> DataFrame:
    """Join a (cell, level) table to the held-out rows of each cell."""
    fitted = lookup(table.select(*CELL, *level, F.col("enc").alias(out)))
    return with_cells(df, folds, key).join(fitted, [*CELL, *level], "left")
