"""Scores, importance weights, paired tests, bootstraps and gates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import keyed_hash
from ..functions.rowwise import clip, col, squared_error
from ..functions.solvers import student_t_two_sided
from ..session import lookup, stored
from .encoders import robust_scale
from .folds import CELL, with_cells
from .ranks import cumulative, with_ranks

ACCEPT_K = 0.25
REDUNDANT_CORR = 0.97


def range_report(df: DataFrame, pred: str, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Rows, non-finite values and values outside the range before clipping."""
    p = F.col(pred)
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(bad.cast("long")).alias("n_bad"),
        F.sum((~bad & ((p < lo) | (p > hi))).cast("long")).alias("n_out_of_range"),
        F.min(clip(p, lo, hi)).alias("min_clipped"),
        F.max(clip(p, lo, hi)).alias("max_clipped"),
    )


def cell_mse(df: DataFrame, folds: DataFrame, target: str, pred: str, key: str = "row_id",
             groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(weighted) MSE after clipping per (repeat, fold)."""
    e = squared_error(target, clip(pred))
    score = F.avg(e) if weight is None else F.sum(F.col(weight) * e) / F.sum(weight)
    return with_cells(df, folds, key).groupBy(*groups, *CELL).agg(F.count("*").alias("n"), score.alias("mse"))


def cv_summary(cells: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over the cells."""
    return cells.groupBy(*groups).agg(
        F.count("*").alias("n_cells"), F.avg("mse").alias("cv_mean"), F.stddev_pop("mse").alias("cv_std"))


def level_ratios(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Mean-one importance ratio P_test(v) / P_train(v) per level of a column.

    The normalising mean is taken over the level table (weighted by training
    counts), so rows are read once per side.
    """
    n_tr = train.groupBy(column).agg(F.count("*").cast("double").alias("n_tr"))
    n_te = test.groupBy(column).agg(F.count("*").cast("double").alias("n_te"))
    both = n_tr.join(n_te, column, "left").select(column, "n_tr", F.coalesce("n_te", F.lit(0.0)).alias("n_te"))
    raw = F.col("n_te") / F.col("n_tr")
    mean = both.agg((F.sum("n_te") / F.sum("n_tr")).alias("m")).scalar()
    return both.select(column, (raw / mean).alias("w"))


def importance_weights(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Training rows with their importance weight ``w``."""
    return train.join(lookup(level_ratios(train, test, column)), column)


def weighted_mse(df: DataFrame, target: str, pred: str, weight: str, groups: Sequence[str] = ()) -> DataFrame:
    e = squared_error(target, clip(pred))
    return df.groupBy(*groups).agg((F.sum(F.col(weight) * e) / F.sum(weight)).alias("rw_mse"))


def acceptance_gate(new: Column, old: Column, std: Column, k: float = ACCEPT_K) -> Column:
    """Accept only an improvement larger than k deviations."""
    return new < old - F.lit(k) * std


def gap_status(public: Column, mean: Column, std: Column) -> Column:
    """Symmetric traffic light for the distance between two scores."""
    gap = F.abs(public - mean)
    return F.when(gap <= 1.5 * std, "green").when(gap <= 3.0 * std, "yellow").otherwise("red")


def roc_auc(df: DataFrame, label: str | Column, score: str, groups: Sequence[str] = (), domain=None) -> DataFrame:
    """Exact area under the ROC curve; ties count half, NULL when a class is missing.

    Rows are scored once: their counts by score and label are written out, the ranks read the counts.
    """
    y = col(label).cast("double")
    counted = stored(df.filter(F.col(score).isNotNull()).groupBy(*groups, score, y.alias("_label")).agg(F.count("*").alias("_rows")), "counted")
    pos, n = F.col("_label"), F.col("_rows")
    table = cumulative(counted, score, groups, {"pos": pos * n, "neg": (1.0 - pos) * n}, domain)
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg")) + 0.5 * F.col("pos") * F.col("neg"))
    pairs = F.max("total_pos") * F.max("total_neg")
    return table.groupBy(*groups).agg((won / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def spearman(df: DataFrame, a: str, b: str, domain_a=None, domain_b=None) -> DataFrame:
    ranked = with_ranks(df.select(a, b), {"_ra": (a, domain_a), "_rb": (b, domain_b)})
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def paired_cells(base: DataFrame, new: DataFrame) -> DataFrame:
    """One row: improved cells, mean and sample deviation of the per-cell change, t."""
    d = base.select(*CELL, F.col("mse").alias("b")).join(new.select(*CELL, F.col("mse").alias("c")), CELL).select(
        (F.col("c") - F.col("b")).alias("d"))
    mean, dev, n = F.avg("d"), F.stddev_samp("d"), F.count("*")
    return d.agg(
        n.alias("n_cells"), F.sum((F.col("d") < 0).cast("long")).alias("improved"),
        mean.alias("d_mean"), dev.alias("d_std"),
        (mean / F.nullif(dev / F.sqrt(n), F.lit(0.0))).alias("t_stat"),
    )


def with_p_value(paired: DataFrame) -> DataFrame:
    """Add the two-sided Student p-value to the one-row paired result."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["p_value"] = [
                None if pd.isna(t) else student_t_two_sided(float(t), int(n) - 1) for t, n in zip(b.t_stat, b.n_cells)
            ]
            yield b

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paired.schema.fields)
    return paired.mapInPandas(add, f"{fields}, p_value double")


# Cumulative Poisson(1) probabilities P(N <= k), k = 0..15.
_POISSON1 = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 16.0)])))


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit counters into uniform 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap_deltas(df: DataFrame, key: str, weight: Column, err_base: Column, err_new: Column,
                     n_boot: int = 5000, seed: int = 42, chunk: int = 100) -> DataFrame:
    """Poisson bootstrap of the weighted-MSE change: (b, delta).

    Every row draws its multiplicities from its own key, so the draw does not depend
    on the partitioning; a task emits ``n_boot`` partial sums, whatever its row count.
    """
    rows = df.select(keyed_hash(key, seed).alias("h"), F.col(key).cast("long").alias("k"), weight.cast("double").alias("w"),
                     err_base.cast("double").alias("e0"), err_new.cast("double").alias("e1"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((n_boot, 3))
        with np.errstate(over="ignore"):
            for b in batches:
                base = _mix((b.h.to_numpy().astype(np.uint64) << np.uint64(32)) ^ b.k.to_numpy().astype(np.uint64))
                parts = np.column_stack([b.w, b.w * b.e0, b.w * b.e1])
                for at in range(0, n_boot, chunk):
                    steps = np.arange(at + 1, min(at + chunk, n_boot) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    u = (_mix(base[:, None] + steps[None, :]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                    times = np.searchsorted(_POISSON1, u.ravel()).reshape(u.shape)
                    sums[at:at + len(steps)] += times.T @ parts
        yield pd.DataFrame({"b": np.arange(n_boot), "sw": sums[:, 0], "s0": sums[:, 1], "s1": sums[:, 2]})

    merged = rows.mapInPandas(partial, "b int, sw double, s0 double, s1 double").groupBy("b").agg(
        *[F.sum(c).alias(c) for c in ("sw", "s0", "s1")])
    return merged.filter("sw > 0").select("b", ((F.col("s1") - F.col("s0")) / F.col("sw")).alias("delta"))


def bootstrap_interval(deltas: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile interval and share of non-negative changes (``n_boot`` rows only)."""
    tail = (1.0 - level) / 2.0
    return deltas.agg(
        F.count("*").alias("n_boot"), F.avg("delta").alias("delta_mean"),
        F.percentile("delta", tail).alias("ci_lo"), F.percentile("delta", 1.0 - tail).alias("ci_hi"),
        F.avg((F.col("delta") >= 0).cast("double")).alias("p_ge0"),
    )


def blocked_bootstrap(cells: DataFrame, n_boot: int = 2000, seed: int = 42, within_repeat: bool = False) -> DataFrame:
    """Resample whole cells (or folds within a repeat) from their sums (sw, s0, s1)."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        pdf = pdf.sort_values(CELL).reset_index(drop=True)
        sums = pdf[["sw", "s0", "s1"]].to_numpy()
        groups = [g.index.to_numpy() for _, g in pdf.groupby("repeat")] if within_repeat else [np.arange(len(pdf))]
        picks = np.concatenate([g[rng.integers(0, len(g), (n_boot, len(g)))] for g in groups], axis=1)
        total = sums[picks].sum(axis=1)
        return pd.DataFrame({"b": np.arange(n_boot), "delta": (total[:, 2] - total[:, 1]) / total[:, 0]})

    # At most repeats x folds rows reach this one group.
    return cells.groupBy(F.lit(0).alias("_all")).applyInPandas(draw, "b int, delta double")


def cell_error_sums(df: DataFrame, folds: DataFrame, weight: str, err_base: Column, err_new: Column, key: str = "row_id") -> DataFrame:
    w = F.col(weight)
    return with_cells(df, folds, key).groupBy(*CELL).agg(
        F.sum(w).alias("sw"), F.sum(w * err_base).alias("s0"), F.sum(w * err_new).alias("s1"))


def gate_verdict(paired: DataFrame, interval: DataFrame) -> DataFrame:
    """All four conditions: lower, >= 80 % of cells, p < 0.01, interval below zero."""
    ci = interval.select(F.struct(*interval.columns)).scalar()
    return paired.select("*", *[ci[c].alias(c) for c in interval.columns]).withColumn(
        "accepted",
        (F.col("d_mean") < 0) & (F.col("improved") >= F.ceil(0.8 * F.col("n_cells")))
        & F.coalesce(F.col("p_value") < 0.01, F.lit(False)) & (F.col("ci_hi") < 0),
    )


def gain_concentration(df: DataFrame, target: str, base: str, new: str, top: int, key: str = "row_id") -> DataFrame:
    """How much of the net squared-error gain the best ``top`` rows hold; rows helped and hurt."""
    gains = df.select(key, (squared_error(target, base) - squared_error(target, new)).alias("gain"))
    best = gains.orderBy(F.col("gain").desc(), key).limit(top).agg(F.sum("gain").alias("g")).scalar()
    return gains.agg(
        F.count("*").alias("n_rows"), F.sum("gain").alias("net_gain"),
        F.sum((F.col("gain") > 0).cast("long")).alias("n_helped"), F.sum((F.col("gain") < 0).cast("long")).alias("n_hurt"),
    ).select("*", best.alias("top_gain")).withColumn("top_share", F.col("top_gain") / F.nullif("net_gain", F.lit(0.0)))


def variance_ratio(df: DataFrame, target: str, weight: str) -> DataFrame:
    """Weighted over plain population variance of the target."""
    y, w = F.col(target), F.col(weight)
    return df.agg(
        F.sum(w).alias("sw"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"), F.var_pop(y).alias("v")
    ).select(((F.col("swyy") / F.col("sw") - F.pow(F.col("swy") / F.col("sw"), F.lit(2.0))) / F.col("v")).alias("var_ratio"))


# ---- density-ratio weights -------------------------------------------------------

# Kernel widths, penalties, mixing shares and number of kernel centres that are tried.
SIGMA_SCALES = (0.5, 1.0, 2.0)
LAMBDAS = (1e-3, 1e-2, 1e-1, 1.0)
ALPHAS = (0.1, 0.2, 0.3, 0.5)
N_CENTERS = 200


def _scaled_vector(df: DataFrame, columns: Sequence[str], stats: dict[str, tuple[float, float]]) -> DataFrame:
    vec = F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(stats[c][0])) - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in columns])
    return df.withColumn("_x", vec)


def density_ratio(train: DataFrame, test: DataFrame, columns: Sequence[str], key: str = "row_id", seed: int = 42,
                  alphas: Sequence[float] = ALPHAS, sigma_scales: Sequence[float] = SIGMA_SCALES,
                  lambdas: Sequence[float] = LAMBDAS, n_centers: int = N_CENTERS):
    """Relative density-ratio weights on radial basis functions.

    Second moments of the basis are summed on the cluster once for all bandwidths;
    every (alpha, bandwidth, penalty) is then solved and compared from those sums,
    since the objective only needs E[phi phi'] and E[phi].  Returns
    ``(info, weighted)``: one record per alpha and a function that attaches the
    mean-one weight for one alpha.
    """
    columns = list(columns)
    stats = {r["column"]: (r["median"], r["scale"]) for r in robust_scale(train, test, columns).collect()}
    tr, te = _scaled_vector(train, columns, stats), _scaled_vector(test, columns, stats)
    sample = np.array([r["_x"] for r in te.select("_x", keyed_hash(key, seed).alias("h"), key).orderBy("h", key).limit(700).collect()])
    centers, probe = sample[:n_centers], sample[-500:]
    d2 = np.maximum(((probe[:, None, :] - probe[None, :, :]) ** 2).sum(-1), 0.0)[np.triu_indices(len(probe), 1)]
    sigma0 = float(np.sqrt(np.median(d2))) if len(d2) and np.median(d2) > 1e-12 else 1.0
    sigmas = [sigma0 * s for s in sigma_scales]
    k = len(centers)
    shipped = train.sparkSession.sparkContext.broadcast(centers)

    def basis(x: np.ndarray, sigma: float) -> np.ndarray:
        c = shipped.value
        dist = (x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2.0 * x @ c.T
        return np.exp(-np.maximum(dist, 0.0) / (2.0 * sigma * sigma))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
        for b in batches:
            for side, part in b.groupby("side"):
                x = np.vstack(part["_x"].to_numpy())
                for i, s in enumerate(sigmas):
                    phi = basis(x, s)
                    h2, h1, n = acc.get((side, i), (np.zeros((k, k)), np.zeros(k), 0))
                    acc[(side, i)] = (h2 + phi.T @ phi, h1 + phi.sum(0), n + len(x))
        for (side, i), (h2, h1, n) in acc.items():
            yield pd.DataFrame({"side": [side], "sigma": [i], "v": [np.concatenate([[n], h1, h2.ravel()])]})

    both = tr.select("_x", F.lit(0).alias("side")).unionByName(te.select("_x", F.lit(1).alias("side")))
    sums = (
        both.mapInPandas(partial, "side int, sigma int, v array<double>")
        .select("side", "sigma", F.posexplode("v").alias("pos", "val"))
        .groupBy("side", "sigma", "pos").agg(F.sum("val").alias("val"))
        .groupBy("side", "sigma").agg(F.array_sort(F.collect_list(F.struct("pos", "val"))).alias("v"))
    )
    moments = {}
    for r in sums.collect():
        v = np.array([e["val"] for e in r["v"]])
        moments[(r["side"], r["sigma"])] = (v[1:k + 1] / v[0], v[k + 1:].reshape(k, k) / v[0])
    solved = {}
    for a in alphas:
        best = None
        for i, s in enumerate(sigmas):
            (h_tr, m_tr), (h_te, m_te) = moments[(0, i)], moments[(1, i)]
            big = (1.0 - a) * m_tr + a * m_te
            for lam in lambdas:
                theta = np.linalg.solve(big + lam * np.eye(k), h_te)
                pe = -0.5 * theta @ big @ theta + h_te @ theta - 0.5
                if best is None or pe > best[0]:
                    best = (float(pe), i, lam, theta)
        solved[a] = best

    def raw_ratio(a: float):
        _, i, _, theta = solved[a]
        sigma = sigmas[i]

        @F.pandas_udf("double")
        def ratio(x: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(basis(np.vstack(x.to_numpy()), sigma) @ theta, 0.0))

        return ratio

    rated = tr
    for j, a in enumerate(alphas):
        rated = rated.withColumn(f"_r{j}", raw_ratio(a)("_x"))
    agg = rated.agg(F.count("*").alias("n"), *[F.sum(f"_r{j}").alias(f"s{j}") for j in range(len(alphas))],
                    *[F.sum(F.col(f"_r{j}") * F.col(f"_r{j}")).alias(f"q{j}") for j in range(len(alphas))]).first()
    info = []
    for j, a in enumerate(alphas):
        s, q, n = agg[f"s{j}"], agg[f"q{j}"], agg["n"]
        info.append(dict(alpha=float(a), sigma=float(sigmas[solved[a][1]]), lam=float(solved[a][2]), pe=solved[a][0],
                         ess=float(s * s / q) if q > 0 else 0.0, ess_frac=float(s * s / q / n) if q > 0 else 0.0))

    def weighted(a: float) -> DataFrame:
        j = list(alphas).index(a)
        mean = agg[f"s{j}"] / agg["n"] if agg[f"s{j}"] > 0 else 1.0
        return rated.withColumn("w", F.col(f"_r{j}") / F.lit(float(mean))).drop("_x", *[f"_r{i}" for i in range(len(alphas))])

    return info, weighted


def choose_alpha(info: Sequence[dict], floor: float = 0.5) -> float:
    """Smallest alpha whose effective sample is large enough, else the one with the largest."""
    for rec in info:
        if rec["ess_frac"] >= floor:
            return rec["alpha"]
    return max(info, key=lambda r: r["ess_frac"])["alpha"]
