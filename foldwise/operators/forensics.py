"""Residual and target-distribution diagnostics; each report is one or two aggregates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import clip, squared_error
from ..session import pin
from .profile import melt
from .ranks import bin_of, quantile_edges, with_ranks

DOMAIN = (0.0, 100.0)


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def count_if(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("long"))


def on_grid(y: Column, scale: float, tol: float = 1e-6) -> Column:
    return F.abs(y * scale - F.round(y * scale)) < tol


def target_fingerprint(df: DataFrame, target: str) -> DataFrame:
    """Mass at the ends, decimal grid and counts of narrow bands below the cap."""
    y = F.col(target)
    bands = {"n_98_99": (98.0, 99.0), "n_99_9999": (99.0, 99.99), "n_9999_100": (99.99, 100.0), "n_95_100": (95.0, 100.0), "n_995_100": (99.5, 100.0)}
    return df.agg(
        F.count(y).alias("n"), count_if(F.abs(y - 100.0) < 1e-6).alias("n_cap"), count_if(F.abs(y) < 1e-6).alias("n_floor"),
        count_if(on_grid(y, 1.0)).alias("n_integer"), count_if(on_grid(y, 10.0)).alias("n_grid_01"), count_if(on_grid(y, 100.0)).alias("n_grid_001"),
        *[count_if((y >= a) & (y < b)).alias(n) for n, (a, b) in bands.items()])


def residual_moments(df: DataFrame, target: str, pred: str) -> DataFrame:
    """Residual spread, means at the cap and inside, bias-corrected skew and kurtosis."""
    r, y = F.col(target) - clip(pred), F.col(target)
    s = df.agg(
        F.count("*").cast("double").alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.var_pop(r).alias("var"),
        F.avg(F.when(y >= 100, r)).alias("mean_at_cap"), F.avg(F.when((y > 0.5) & (y < 99.5), r)).alias("mean_interior"),
        F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))
    n = F.col("n")
    return s.select(
        "n", "mean", "std", "var", "mean_at_cap", "mean_interior",
        (F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1")).alias("skew"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"))


def by_prediction_bin(df: DataFrame, target: str, pred: str, bins: int) -> DataFrame:
    """Prediction mean, residual mean and spread (and of its size), cap share per bin."""
    r = F.col(target) - F.col(pred)
    edges = quantile_edges(df, pred, bins, DOMAIN)
    return df.groupBy(bin_of(pred, edges).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(pred).alias("pred_mean"), F.avg(r).alias("res_mean"), F.stddev_samp(r).alias("res_std"),
        F.stddev_samp(F.abs(r)).alias("abs_res_std"), share(F.abs(r) < 0.5).alias("near0_rate"), share(F.col(target) >= 100).alias("cap_rate"))


def spread_law(df: DataFrame, target: str, pred: str, bins: int = 8) -> DataFrame:
    """Line through (bin mean, spread): of the residual and, literally, of its size."""
    b = by_prediction_bin(df, target, pred, bins)
    return b.agg(
        F.regr_slope("res_std", "pred_mean").alias("slope"), F.regr_intercept("res_std", "pred_mean").alias("intercept"),
        F.regr_slope("abs_res_std", "pred_mean").alias("slope_abs"), F.regr_intercept("abs_res_std", "pred_mean").alias("intercept_abs"))


def mse_parts(df: DataFrame, target: str, pred: str) -> DataFrame:
    y, e = F.col(target), squared_error(target, clip(pred))
    at_cap, inside = y >= 100, (y > 0.5) & (y < 99.5)
    return df.agg(
        F.avg(e).alias("mse"), F.avg(F.when(inside, e)).alias("mse_interior"), F.avg(F.when(at_cap, e)).alias("mse_at_cap"),
        count_if(inside).alias("n_interior"), count_if(at_cap).alias("n_at_cap"),
        (F.sum(F.when(at_cap, e).otherwise(0.0)) / F.count("*")).alias("cap_contribution"),
        F.avg(F.when(at_cap, squared_error(target, F.lit(100.0))).otherwise(e)).alias("mse_oracle"))


def push_sweep(df: DataFrame, target: str, pred: str, thresholds: Sequence[float]) -> DataFrame:
    """Effect of lifting predictions above a threshold to the cap, all thresholds in one pass."""
    y, p = F.col(target), clip(pred)
    base = squared_error(target, p)
    rows = {}
    for t in thresholds:
        up = p >= t
        rows[str(t)] = F.struct(
            count_if(up).alias("n"), share(F.when(up, y >= 100)).alias("prec"),
            (F.avg(F.when(up, squared_error(target, F.lit(100.0))).otherwise(base)) - F.avg(base)).alias("d"))
    return melt(df, rows, "threshold").select(
        F.col("threshold").cast("double").alias("threshold"), F.col("value.n").alias("n_pushed"),
        F.col("value.prec").alias("precision"), F.col("value.d").alias("mse_delta"))


def near_zero(df: DataFrame, target: str, pred: str) -> DataFrame:
    """Rows with tiny residuals against the share a normal residual would give."""
    y, r = F.col(target), F.col(target) - clip(pred)
    near = F.abs(r) < 0.5
    return df.agg(
        count_if(near).alias("n_near"), share(near).alias("share"), count_if(F.abs(r) < 0.1).alias("n_01"),
        (1.0 / (F.stddev_pop(r) * math.sqrt(2.0 * math.pi))).alias("expected_share"),
        count_if(near & (y >= 100)).alias("n_near_cap"), count_if(near & (y > 0.5) & (y < 99.5)).alias("n_near_interior"))


def model_disagreement(df: DataFrame, target: str, a: str, b: str) -> DataFrame:
    pa, pb = clip(a), clip(b)
    s = df.agg(F.stddev_pop(pa - pb).alias("disagree_std"), F.stddev_pop(F.col(target) - 0.5 * (pa + pb)).alias("resid_std"))
    ratio = F.col("disagree_std") / F.col("resid_std")
    return s.select("disagree_std", "resid_std", (1.0 - ratio * ratio).alias("irreducible"))


def affine_fit(df: DataFrame, target: str, pred: str, weight: str, literal: bool = False) -> DataFrame:
    """Weighted y = a*p + b and the weighted MSE before and after.

    ``literal`` reproduces the row scaling by the weight itself, which acts as a
    squared weight in the fit.
    """
    y, p, w = F.col(target), F.col(pred), F.col(weight)
    fw = w * w if literal else w
    s = df.agg(F.struct(F.sum(fw).alias("s"), F.sum(fw * p).alias("sp"), F.sum(fw * y).alias("sy"), F.sum(fw * p * p).alias("spp"), F.sum(fw * p * y).alias("spy"))).scalar()
    a = (s["spy"] - s["sp"] * s["sy"] / s["s"]) / (s["spp"] - s["sp"] * s["sp"] / s["s"])
    b = (s["sy"] - a * s["sp"]) / s["s"]
    fitted = df.select(y.alias("_y"), w.alias("_w"), p.alias("_p"), a.alias("a"), b.alias("b"))
    before, after = squared_error("_y", clip("_p")), squared_error("_y", clip(F.col("a") * F.col("_p") + F.col("b")))
    return fitted.agg(
        F.first("a").alias("a"), F.first("b").alias("b"), (F.sum(F.col("_w") * before) / F.sum("_w")).alias("rw_before"),
        (F.sum(F.col("_w") * after) / F.sum("_w")).alias("rw_after"))




def error_budget(df: DataFrame, target: str, pred: str, edges: Sequence[float], bad: float) -> DataFrame:
    """Rows, share of bad rows and mean residual per target band."""
    r = F.col(target) - F.col(pred)
    return df.groupBy(bin_of(target, edges).alias("band")).agg(
        F.count("*").alias("n"), share(F.abs(r) >= bad).alias("bad_share"), F.avg(r).alias("res_mean"), F.sum(r * r).alias("sse"))


def hypothesis_probe(df: DataFrame, patterns: Mapping[str, Column], target: str, pred: str) -> DataFrame:
    """Correlation of each pattern with the target, the prediction and the residual."""
    r = F.col(target) - F.col(pred)
    rows = {n: F.struct(F.corr(c.cast("double"), F.col(target)).alias("y"), F.corr(c.cast("double"), F.col(pred)).alias("p"), F.corr(c.cast("double"), r).alias("r")) for n, c in patterns.items()}
    return melt(df, rows, "pattern").select("pattern", F.col("value.y").alias("corr_y"), F.col("value.p").alias("corr_pred"), F.col("value.r").alias("corr_resid"))


def rule_triggers(df: DataFrame, rules: Mapping[str, Column], target: str, pred: str, small: int = 30) -> DataFrame:
    """Rows fired per rule and their mean residual against the whole population."""
    r = F.col(target) - F.col(pred)
    rows = {n: F.struct(count_if(c).alias("n"), F.avg(F.when(c, r)).alias("m"), F.avg(r).alias("a")) for n, c in rules.items()}
    return melt(df, rows, "rule").select(
        "rule", F.col("value.n").alias("n_fired"), F.col("value.m").alias("res_fired"), F.col("value.a").alias("res_all"),
        (F.col("value.n") < small).alias("small_n"))


def calibration_by_feature(df: DataFrame, feature: str, target: str, pred: str, bins: int = 5) -> DataFrame:
    edges = quantile_edges(df.filter(F.col(feature).isNotNull()), feature, bins)
    r = F.col(target) - F.col(pred)
    return df.filter(F.col(feature).isNotNull()).groupBy(bin_of(feature, edges).alias("bin")).agg(F.count("*").alias("n"), F.avg(r).alias("res_mean"))


def confidence(df: DataFrame, spread: str, pred: str, w_spread: float = 0.6) -> DataFrame:
    """Confidence in [0, 1]: agreement rank blended with the prediction rank.

    The input is ranked twice and joined back, so it is pinned first.
    """
    ranked = with_ranks(pin(df), {"_rs": (spread, DOMAIN), "_rp": (pred, DOMAIN)}, percent=True)
    return ranked.withColumn("confidence", w_spread * (1.0 - F.col("_rs")) + (1.0 - w_spread) * F.col("_rp")).drop("_rs", "_rp")


def mse_by_decile(df: DataFrame, value: str, target: str, pred: str, bins: int = 10) -> DataFrame:
    edges = quantile_edges(df, value, bins, (0.0, 1.0))
    return df.groupBy(bin_of(value, edges).alias("decile")).agg(F.count("*").alias("n"), F.avg(squared_error(target, pred)).alias("mse"))
