"""Nested calibration: parameter grids, isotonic maps, bin shrinkage and confidence gates.

A grid is a dictionary of candidate prediction columns.  Each cell's loss per
candidate is additive, so the training loss is total minus cell and the choice
for all cells comes from one aggregate; only (cells x candidates) numbers reach
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import add_all, clip, dot, squared_error
from ..functions.solvers import normal_cdf, normal_pdf, ridge_from_moments
from ..session import pin
from .folds import CELL, expand_to_training, inner_split
from .ranks import exact_quantiles, training_quantiles

# The tried gate quantiles, gate strengths and cap-pull strengths.
Q_GRID = (0.85, 0.90, 0.95)
A_GRID = (0.0, 0.2, 0.3, 0.4, 0.5)
ALPHA_GRID = tuple(round(0.1 * i, 1) for i in range(16))
MIN_CELL = 300

Choice = dict[tuple[int, int], str]


def _cells(df: DataFrame) -> DataFrame:
    """Rows next to their (repeat, fold) cells, unfolded from the fold array."""
    return df.select("*", F.posexplode("folds").alias("repeat", "fold"))


def choose_per_cell(df: DataFrame, candidates: Mapping[str, Column], target: str, weight: str) -> Choice:
    """Best candidate per cell by the weighted training loss (first one wins ties)."""
    names = list(candidates)
    w = F.col(weight)
    losses = df.select("folds", *[(w * squared_error(target, clip(c))).alias(f"l{i}") for i, c in enumerate(candidates.values())])
    rows = _cells(losses).groupBy(*CELL).agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(len(names))]).collect()
    table = {(r["repeat"], r["fold"]): np.array([r[f"l{i}"] for i in range(len(names))]) for r in rows}
    total = {}
    for (r, _), v in table.items():
        total[r] = total.get(r, 0.0) + v
    return {c: names[int(np.argmin(total[c[0]] - v))] for c, v in table.items()}


def apply_choice(candidates: Mapping[str, Column], choice: Choice) -> Column:
    """Clipped mean over repeats of each row's chosen candidate."""
    repeats = sorted({r for r, _ in choice})
    parts = []
    for r in repeats:
        arms = F.lit(None).cast("double")
        for f in sorted(f for rr, f in choice if rr == r):
            arms = F.when(F.col("folds")[r] == f, clip(candidates[choice[(r, f)]])).otherwise(arms)
        parts.append(arms)
    return clip(add_all(parts) / len(parts))


def nested_grid(df: DataFrame, candidates: Mapping[str, Column], target: str, weight: str, out: str = "post") -> tuple[DataFrame, Choice]:
    choice = choose_per_cell(df, candidates, target, weight)
    return df.withColumn(out, apply_choice(candidates, choice)), choice


def nested_cells(df: DataFrame, candidates: Mapping[tuple[int, int], Mapping[str, Column]], target: str, weight: str, out: str = "post") -> tuple[DataFrame, Choice]:
    """As ``nested_grid`` for candidates that were themselves fitted per cell: one pass for all training losses."""
    w = F.col(weight)
    names = list(next(iter(candidates.values())))
    sums = []
    for (r, f), cands in candidates.items():
        trains = F.col("folds")[r] != f
        sums += [F.sum(F.when(trains, w * squared_error(target, clip(c)))).alias(f"l{r}_{f}_{i}") for i, c in enumerate(cands.values())]
    row = df.agg(*sums).first()
    choice = {(r, f): names[int(np.argmin([row[f"l{r}_{f}_{i}"] for i in range(len(names))]))] for r, f in candidates}
    flat = {f"{c[0]}|{c[1]}": candidates[c][n] for c, n in choice.items()}
    return df.withColumn(out, apply_choice(flat, {c: f"{c[0]}|{c[1]}" for c in choice})), choice


def best_overall(df: DataFrame, candidates: Mapping[str, Column], target: str, weight: str) -> str:
    """The candidate chosen on all rows, to be frozen for the test side."""
    names = list(candidates)
    row = df.agg(*[F.sum(F.col(weight) * squared_error(target, clip(c))).alias(f"l{i}") for i, c in enumerate(candidates.values())]).first()
    return names[int(np.argmin([row[f"l{i}"] for i in range(len(names))]))]


# ---- candidate families ----------------------------------------------------------


def cap_pull(pred: str, prob: str, grid: Sequence[float] = ALPHA_GRID) -> dict[str, Column]:
    """pred + a * p * (100 - pred)."""
    return {f"a={a:g}": F.col(pred) + F.lit(float(a)) * F.col(prob) * (100.0 - F.col(pred)) for a in grid}


def low_pull(pred: str, prob: str, grid: Sequence[float]) -> dict[str, Column]:
    """pred - b * P(low)."""
    return {f"b={b:g}": F.col(pred) - F.lit(float(b)) * F.col(prob) for b in grid}


def gate(pred: str, model: str, threshold: Column | float, a: float, centre: float) -> Column:
    """Move toward the model where it is confidently above the centre."""
    m, p = F.col(model), F.col(pred)
    thr = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    fired = (F.abs(m - centre) >= thr) & (m > centre)
    return clip(F.when(fired, p + F.lit(float(a)) * (m - p)).otherwise(p))


def two_way_gate(pred: str, model: str, thr: float, up: float, down: float, centre: float) -> Column:
    m, p = F.col(model), F.col(pred)
    far = F.abs(m - centre) >= thr
    return F.when(far & (m > centre), p + up * (m - p)).when(far & (m < centre), p + down * (m - p)).otherwise(p)


def sigmoid_gate(pred: str, model: str, thr: float, a: float, centre: float, width: float = 3.0) -> Column:
    m, p = F.col(model), F.col(pred)
    return p + a * (m - p) / (1.0 + F.exp(-(m - centre - thr) / width))


def band_gate(pred: str, model: str, lo: float, hi: float, a: float) -> Column:
    m, p = F.col(model), F.col(pred)
    return F.when((p >= lo) & (p < hi), p + a * (m - p)).otherwise(p)


def zoo(pred: str) -> dict[str, dict[str, Column]]:
    """Small post-processing families; every family holds its own do-nothing candidate."""
    p = F.col(pred)
    return {
        "affine": {f"s={s:g},t={t:g}": s * p + t for s in (1.0, 0.95, 1.05, 1.1) for t in (0.0, -2.0, 2.0, -5.0)},
        "gamma": {f"g={g:g}": 100.0 * F.pow(clip(p) / 100.0, F.lit(g)) for g in (1.0, 0.8, 0.9, 1.1, 1.25)},
        "hinge": {f"k={k:g},d={d:g}": p + d * F.greatest(p - k, F.lit(0.0)) for k in (40.0, 60.0, 75.0) for d in (0.0, -0.2, 0.2, 0.4)},
        "winsor": {f"lo={lo:g},hi={hi:g}": F.least(F.greatest(p, F.lit(lo)), F.lit(hi)) for lo in (0.0, 5.0, 10.0) for hi in (100.0, 95.0, 90.0)},
        "snap": {f"thr={t:g}": F.when(p >= t, 100.0).otherwise(p) for t in (101.0, 84.0, 87.0, 90.0, 93.0)},
        "top": {f"thr={t:g},a={a:g}": F.when(p >= t, p + a * (100.0 - p)).otherwise(p) for t in (75.0, 85.0) for a in (0.0, 0.2, 0.4)},
    }


def chain(df: DataFrame, stages: Mapping[str, object], pred: str, target: str, weight: str) -> tuple[DataFrame, list[tuple[str, float]]]:
    """Apply nested stages one after the other; a stage stays only if it lowers the score.

    ``stages`` maps a name to a function that builds candidates from a column name.
    """
    score = lambda d, c: float(d.agg((F.sum(F.col(weight) * squared_error(target, clip(c))) / F.sum(weight)).alias("s")).first()["s"])
    current, best, kept = pred, score(df, pred), []
    for i, (name, make) in enumerate(stages.items()):
        out = f"_stage{i}"
        trial, _ = nested_grid(df, make(current), target, weight, out)
        s = score(trial, out)
        if s < best:
            df, current, best = trial, out, s
            kept.append((name, s))
    return df.withColumn("post", clip(current)), kept


# ---- nested confidence gate ------------------------------------------------------


def gate_thresholds(df: DataFrame, model: str, centre: float, q_grid: Sequence[float] = Q_GRID) -> DataFrame:
    """Training quantiles of the upward confidence per cell: (repeat, fold, q0..)."""
    up = df.filter(F.col(model) > centre).select("folds", (F.col(model) - centre).alias("conf"))
    return training_quantiles(up, "conf", list(q_grid), (), (0.0, 100.0 - centre))


def gate_losses(df: DataFrame, thresholds: Mapping[tuple[int, int], Sequence[float]], pred: str, model: str, target: str, weight: str,
                centre: float, a_grid: Sequence[float]) -> dict[tuple[int, int], np.ndarray]:
    """(thresholds x strengths) training losses of every cell, in one pass.

    A task scores its rows against every cell's thresholds in whole columns and emits
    one sum per cell and parameter; no row is repeated.
    """
    cells = sorted(thresholds)
    grid = np.array([thresholds[c] for c in cells], dtype=float)
    strengths = np.array(a_grid, dtype=float)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cells), grid.shape[1], len(strengths)))
        for batch in batches:
            folds = batch.column("folds")
            at = np.asarray(folds.flatten()).reshape(len(folds), -1)
            p, m, y, w = (np.asarray(batch.column(c), dtype=float) for c in ("p", "m", "y", "w"))
            trains = np.array([at[:, r] != f for r, f in cells], dtype=float) * w
            for k, a in enumerate(strengths):
                moved = np.clip(p + a * (m - p), 0.0, 100.0)
                stay = np.square(y - np.clip(p, 0.0, 100.0))
                gain = np.square(y - moved) - stay
                for i in range(grid.shape[1]):
                    fired = (m > centre) & (np.abs(m - centre) >= grid[:, i : i + 1])
                    total[:, i, k] += (trains * (stay + fired * gain)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    slim = df.where(F.col(model).isNotNull()).select("folds", *[F.col(c).cast("double").alias(n) for c, n in ((pred, "p"), (model, "m"), (target, "y"), (weight, "w"))])
    sums = sum(np.frombuffer(r["v"], "<f8").reshape(len(cells), grid.shape[1], len(strengths)) for r in slim.mapInArrow(partial, "v binary").collect())
    return dict(zip(cells, sums))


def nested_gate(df: DataFrame, pred: str, model: str, target: str, weight: str, centre: float,
                q_grid: Sequence[float] = Q_GRID, a_grid: Sequence[float] = A_GRID, out: str = "post"):
    """Per cell the (quantile, strength) with the lowest training loss; returns (df, picks)."""
    thr = {(r["repeat"], r["fold"]): [r[f"q{i}"] for i in range(len(q_grid))] for r in gate_thresholds(df, model, centre, q_grid).collect()}
    picks = {}
    for cell, losses in gate_losses(df, thr, pred, model, target, weight, centre, a_grid).items():
        i, k = np.unravel_index(int(np.argmin(losses)), losses.shape)
        picks[cell] = (thr[cell][i], float(a_grid[k]))
    named = {f"{c[0]}|{c[1]}": gate(pred, model, t, a, centre) for c, (t, a) in picks.items()}
    return df.withColumn(out, apply_choice(named, {c: f"{c[0]}|{c[1]}" for c in picks})), picks


# ---- bin shrinkage ---------------------------------------------------------------


def bin_shrink(df: DataFrame, bins: Sequence[Column], pred: str, target: str, alpha: float, min_rows: int, out: str = "post") -> DataFrame:
    """Add each training bin's shrunken residual sum / (n + alpha); thin bins add nothing.

    One row per (row, repeat) is averaged back, so only narrow columns move.
    """
    keys = [f"_k{i}" for i in range(len(bins))]
    base = df.select("row_id", "folds", pred, target, *[b.alias(k) for b, k in zip(bins, keys)])
    long = _cells(base)
    sums = long.groupBy(*CELL, *keys).agg(F.count("*").alias("n"), F.sum(F.col(target) - F.col(pred)).alias("s"))
    train = expand_to_training(sums).groupBy(*CELL, *keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    shift = F.when(F.col("n") >= min_rows, F.col("s") / (F.col("n") + alpha)).otherwise(0.0)
    # cells x bins rows: bounded by the grid, not by the data
    table = F.broadcast(train.select(*CELL, *keys, shift.alias("_shift")))
    moved = long.join(table, [*CELL, *keys], "left").groupBy("row_id").agg(
        clip(F.avg(clip(F.col(pred) + F.coalesce("_shift", F.lit(0.0))))).alias(out))
    return df.join(moved, "row_id")


# ---- risk gate -------------------------------------------------------------------


def risk_gate(df: DataFrame, columns: Sequence[str], pred: str, target: str, weight: str, toward: Mapping[str, Column],
              strengths: Sequence[float] = (0.25, 0.5), share: float = 0.9, n_repeats: int = 3) -> tuple[DataFrame, Choice]:
    """Move rows of high predicted error toward a safer value; everything is fitted inside the cell.

    The risk model of a cell predicts |residual| out of fold over an inner split of its
    training rows (held-out rows take the mean of the inner models); the edge is the
    training rows' ``share`` quantile, the mean theirs too, and the move has the least training loss.
    ``toward`` adds fixed alternatives to the mean.
    """
    from .textridge import N_INNER, nested_vector_moments  # moments of (fold, inner) parts

    vector = F.array(*[F.col(c).cast("double") for c in columns])
    data = df.withColumn("_x", vector).withColumn("_r", F.abs(F.col(target) - F.col(pred)))
    parts = nested_vector_moments(data, "_x", "_r", n_repeats)
    means = cell_means(df, target, n_repeats)
    risks = {}
    for r in range(n_repeats):
        inner = inner_split("row_id", 42, r, N_INNER)
        for f in sorted({f for rr, f, _ in parts if rr == r}):
            train = {k: v for k, v in parts.items() if k[0] == r and k[1] != f}
            total = sum(train.values())
            fits = [ridge_from_moments(total - sum(v for k, v in train.items() if k[2] == i), 1.0) for i in range(N_INNER)]
            own = F.array(*[dot(columns, c, b) for c, b in fits])[inner]
            mean = dot(columns, np.mean([c for c, _ in fits], axis=0), float(np.mean([b for _, b in fits])))
            risks[r, f] = F.when(F.col("folds")[r] == f, mean).otherwise(own)
    cells = sorted(risks)
    data = pin(df.withColumn("_risk", F.array(*[risks[c] for c in cells])))
    each = data.select("folds", F.posexplode("_risk").alias("cell", "risk"))
    repeat, fold = (F.element_at(F.array(*[F.lit(c[i]) for c in cells]), F.col("cell") + 1) for i in (0, 1))
    edges = exact_quantiles(each.where(F.col("folds")[repeat] != fold), "risk", [share], ["cell"])
    edge = {cells[r["cell"]]: r["q0"] for r in edges.collect()}
    candidates = {}
    for j, c in enumerate(cells):
        high = F.col("_risk")[j] >= edge[c]
        options = {"mean": F.lit(means[c]), **toward}
        candidates[c] = {"none": F.col(pred), **{f"{n}|{a:g}": F.when(high, F.col(pred) + a * (t - F.col(pred))).otherwise(F.col(pred)) for n, t in options.items() for a in strengths}}
    done, choice = nested_cells(data, candidates, target, weight)
    flags = add_all([F.when(F.col("folds")[c[0]] == c[1], (F.col("_risk")[j] >= edge[c]).cast("int")).otherwise(0) for j, c in enumerate(cells)])
    return done.withColumn("flagged", flags > 0).drop("_risk"), choice


def cell_means(df: DataFrame, target: str, n_repeats: int) -> dict[tuple[int, int], float]:
    """Mean target of every cell's training rows."""
    rows = _cells(df.select("folds", target)).groupBy(*CELL).agg(F.count("*").alias("n"), F.sum(target).alias("s")).collect()
    total = {r: (sum(x["n"] for x in rows if x["repeat"] == r), sum(x["s"] for x in rows if x["repeat"] == r)) for r in range(n_repeats)}
    return {(x["repeat"], x["fold"]): float((total[x["repeat"]][1] - x["s"]) / (total[x["repeat"]][0] - x["n"])) for x in rows}


# ---- censored expectation --------------------------------------------------------


def clipped_normal_mean(mu: str, sigma: str, scale: float = 1.0) -> Column:
    """E[min(max(N(mu, scale*sigma), 0), 100)]."""

    @F.pandas_udf("double")
    def expect(m: pd.Series, s: pd.Series) -> pd.Series:
        mean, dev = m.to_numpy(dtype=float), np.maximum(s.to_numpy(dtype=float) * scale, 1e-6)
        a, b = (0.0 - mean) / dev, (100.0 - mean) / dev
        inside = mean * (normal_cdf(b) - normal_cdf(a)) + dev * (normal_pdf(a) - normal_pdf(b))
        return pd.Series(inside + 100.0 * (1.0 - normal_cdf(b)))

    return expect(mu, sigma)
