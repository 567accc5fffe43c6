"""Stacking: nested weights, searches over member subsets, and row-wise blend families."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solvers as sv
from ..functions.rowwise import add_all, clip, dot
from ..session import lookup
from .gram import CellMoments, cell_moments, fit_cells, held_out_column, weighted_score

METHODS: dict[str, Callable] = {
    "nnls": sv.nnls_from_moments,
    "ridge_pos": partial(sv.ridge_pos_from_moments, alpha=1.0),
    "ridge": partial(sv.ridge_from_moments, alpha=1.0),
    "lasso": partial(sv.elastic_net_from_moments, alpha=0.01, l1_ratio=1.0),
    "lasso_pos": partial(sv.elastic_net_from_moments, alpha=0.01, l1_ratio=1.0, positive=True),
    "elastic_net": partial(sv.elastic_net_from_moments, alpha=0.01, l1_ratio=0.5),
    "elastic_net_pos": partial(sv.elastic_net_from_moments, alpha=0.01, l1_ratio=0.5, positive=True),
    "bayes_ridge": sv.bayes_ridge_from_moments,
}
GREEDY_EPS = 1e-6


def meta_oof(moments: CellMoments, names: Sequence[str], method: str) -> Column:
    """Clipped nested prediction: every row is scored by weights fitted outside its cell."""
    return clip(held_out_column(list(names), fit_cells(moments.subset(names), METHODS[method])))


def nested_scores(df: DataFrame, moments: CellMoments, candidates: Mapping[str, tuple[Sequence[str], str]],
                  target: str, weight: str | None) -> dict[str, float]:
    """Nested score of many (members, method) candidates: small solves, one scoring pass."""
    return weighted_score(df, {n: meta_oof(moments, cols, m) for n, (cols, m) in candidates.items()}, target, weight)


def candidate_record(df: DataFrame, moments: CellMoments, candidates: Mapping[str, tuple[Sequence[str], str]],
                     target: str, weight: str | None) -> DataFrame:
    """(blend, method, members, weights, intercept, nested score) per candidate."""
    scores = nested_scores(df, moments, candidates, target, weight)
    rows = []
    for n, (cols, method) in candidates.items():
        coef, intercept = METHODS[method](moments.subset(cols).total())
        rows.append((n, method, list(cols), [float(c) for c in coef], float(intercept), scores[n]))
    return df.sparkSession.createDataFrame(
        rows, "blend string, method string, members array<string>, weights array<double>, intercept double, nested_rw double")


def forward_selection(df: DataFrame, moments: CellMoments, models: Sequence[str], target: str, weight: str | None,
                      method: str = "nnls", eps: float = GREEDY_EPS) -> list[tuple[int, str, list[str], float]]:
    """Grow from the best single model while the nested score falls by more than ``eps``."""
    single = weighted_score(df, {m: F.col(m) for m in models}, target, weight)
    chosen = [min(single, key=single.get)]
    current = nested_scores(df, moments, {"start": (chosen, method)}, target, weight)["start"]
    steps = [(0, chosen[0], list(chosen), current)]
    while len(chosen) < len(models):
        trials = {m: ([*chosen, m], method) for m in models if m not in chosen}
        scores = nested_scores(df, moments, trials, target, weight)
        best = min(scores, key=scores.get)
        if scores[best] >= current - eps:
            break
        chosen, current = [*chosen, best], scores[best]
        steps.append((len(steps), best, list(chosen), current))
    return steps


def backward_elimination(df: DataFrame, moments: CellMoments, models: Sequence[str], target: str, weight: str | None,
                         method: str = "ridge_pos", eps: float = GREEDY_EPS) -> list[tuple[int, str, list[str], float]]:
    """Drop members while the nested score falls."""
    chosen = list(models)
    current = nested_scores(df, moments, {"start": (chosen, method)}, target, weight)["start"]
    steps = [(0, "", list(chosen), current)]
    while len(chosen) > 1:
        scores = nested_scores(df, moments, {m: ([c for c in chosen if c != m], method) for m in chosen}, target, weight)
        best = min(scores, key=scores.get)
        if scores[best] >= current - eps:
            break
        chosen, current = [c for c in chosen if c != best], scores[best]
        steps.append((len(steps), best, list(chosen), current))
    return steps


def leave_one_out(df: DataFrame, moments: CellMoments, models: Sequence[str], target: str, weight: str | None, method: str = "ridge_pos") -> dict[str, float]:
    """How much worse the nested score gets without each member."""
    trials = {"_all": (list(models), method), **{m: ([c for c in models if c != m], method) for m in models}}
    scores = nested_scores(df, moments, trials, target, weight)
    return {m: scores[m] - scores["_all"] for m in models}


def squared_loss(m: np.ndarray, coef: np.ndarray, intercept: float) -> float:
    """Summed (weighted) squared error of a linear blend, from the moments of [1, x..., y]."""
    z = np.concatenate([[-intercept], -np.asarray(coef), [1.0]])
    return float(max(z @ m @ z, 0.0))


def best_subsets(m: np.ndarray, solve: Callable = sv.nnls_from_moments) -> dict[int, tuple[tuple[int, ...], float]]:
    """For every size the member subset with the least fitted error, by branch and bound.

    A branch holds a set and the first member that may still be taken out. Taking members out never
    lowers the fitted error, so a set's own error bounds all sets below it; a branch
    is left when no size it can reach could still improve.
    """
    n = len(m) - 2
    best: dict[int, tuple[tuple[int, ...], float]] = {}

    def error(members: tuple[int, ...]) -> float:
        keep = [0, *[1 + i for i in members], n + 1]
        part = m[np.ix_(keep, keep)]
        return squared_loss(part, *solve(part))

    def visit(members: tuple[int, ...], first: int) -> None:
        loss = error(members)
        if len(members) not in best or (loss, members) < (best[len(members)][1], best[len(members)][0]):
            best[len(members)] = (members, loss)
        removable = [i for i in members if i >= first]
        least = max(1, len(members) - len(removable))
        if all(k in best and best[k][1] <= loss for k in range(least, len(members))):
            return
        for i in removable:
            if len(members) > 1:
                visit(tuple(j for j in members if j != i), i + 1)

    visit(tuple(range(n)), 0)
    return best


def subset_search(moments: CellMoments, models: Sequence[str], solve: Callable = sv.nnls_from_moments) -> list[tuple[int, int, list[str], float, float]]:
    """(held repeat, size, members, error on the other repeats, error on the held repeat).

    Subsets are searched inside the training part of every cell; the size is chosen
    on all repeats but one, whose cells then tell what the choice is worth.
    """
    m = moments.subset(models)
    losses: dict[tuple[int, int], float] = {}
    weight = {r: m.total(r)[0, 0] for r in m.repeats}
    for r, f in m.cells:
        for size, (members, _) in best_subsets(m.training(r, f), solve).items():
            keep = [0, *[1 + i for i in members], len(models) + 1]
            fitted = solve(m.training(r, f)[np.ix_(keep, keep)])
            losses[r, size] = losses.get((r, size), 0.0) + squared_loss(m.cells[r, f][np.ix_(keep, keep)], *fitted) / weight[r]
    whole = best_subsets(m.total(m.repeats[0]), solve)
    out = []
    for held in m.repeats:
        others = [r for r in m.repeats if r != held] or [held]
        mean = {k: float(np.mean([losses[r, k] for r in others])) for k in whole}
        size = min(mean, key=lambda k: (mean[k], k))
        out.append((held, size, [models[i] for i in whole[size][0]], mean[size], float(losses[held, size])))
    return out


def picked(m: np.ndarray, members: Sequence[int], rounds: int) -> np.ndarray:
    """Greedy selection with replacement among some members; the weights are the shares of the picks."""
    xx, xy = m[1:-1, 1:-1], m[1:-1, -1]
    picks = np.zeros(len(xy))
    for step in range(1, rounds + 1):
        # error of (picks + e_j) / step, up to a constant
        cross = xx @ picks
        loss = [(picks @ cross + 2 * cross[j] + xx[j, j]) / step**2 - 2 * (xy @ picks + xy[j]) / step for j in members]
        picks[members[int(np.argmin(loss))]] += 1
    return picks / rounds


def bagged_selection(moments: CellMoments, models: Sequence[str], bags: int = 20, share: float = 0.6, rounds: int = 20,
                     seed: int = 42) -> tuple[dict[tuple[int, int], tuple[np.ndarray, float]], np.ndarray]:
    """Selection with replacement from random bags of models, averaged over the bags: (weights of every cell, weights of all rows)."""
    m = moments.subset(models)
    rng = np.random.default_rng(seed)
    size = max(1, round(share * len(models)))
    drawn = [sorted(rng.choice(len(models), size, replace=False)) for _ in range(bags)]
    mean = lambda t: np.mean([picked(t, bag, rounds) for bag in drawn], axis=0)
    return {c: (mean(m.training(*c)), 0.0) for c in m.cells}, mean(m.total(m.repeats[0]))


def segment_fits(df: DataFrame, models: Sequence[str], target: str, weight: str, segment: str, cells: Sequence[tuple[int, int]], method: str) -> DataFrame:
    """``(segment, fits)``: rows, coefficients and intercept of every cell's training part, for any number of segments.

    Tasks add up one moment matrix per segment and cell they see; matrices are summed by position, and
    a segment's (at most one per cell) are solved together.
    """
    names, solve, wide = list(models), METHODS[method], len(models) + 2
    rows = df.select(F.col(segment).cast("string").alias("s"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"),
                     F.col(target).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), "folds")

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            if b.empty:
                continue
            z = np.column_stack([np.ones(len(b)), np.vstack(b.x.to_numpy()), b.y.to_numpy()])
            f, w = np.vstack(b.folds.to_numpy()), b.w.to_numpy()
            level, code = np.unique(b.s.fillna("nan").to_numpy().astype(str), return_inverse=True)
            for r in range(f.shape[1]):
                key = code * 1000 + f[:, r]
                for k in np.unique(key):
                    at = key == k
                    m = np.append((z[at] * w[at, None]).T @ z[at], float(at.sum()))
                    cell = (str(level[k // 1000]), r, int(k % 1000))
                    sums[cell] = sums.get(cell, 0.0) + m
            if len(sums) > 50_000:  # bounded memory: partial sums may be sent more than once
                yield flush(sums)
                sums = {}
        if sums:
            yield flush(sums)

    def flush(sums: dict[tuple, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["s", "repeat", "fold", "m"])

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        mats = {(int(r), int(f)): np.array(m) for r, f, m in zip(pdf["repeat"], pdf.fold, pdf.m)}
        fits = []
        for r, f in cells:
            total = sum((m for (rr, ff), m in mats.items() if rr == r and ff != f), np.zeros(wide * wide + 1))
            n = total[-1]
            coef, intercept = solve(total[:-1].reshape(wide, wide)) if n > len(names) else (np.zeros(len(names)), 0.0)
            fits.append({"n": float(n), "coef": [float(c) for c in coef], "intercept": float(intercept)})
        return pd.DataFrame({"s": [pdf.s.iloc[0]], "fits": [fits]})

    each = rows.mapInPandas(partial_sums, "s string, repeat int, fold int, m array<double>").select("s", "repeat", "fold", F.posexplode("m").alias("pos", "v"))
    summed = each.groupBy("s", "repeat", "fold", "pos").agg(F.sum("v").alias("v")).groupBy("s", "repeat", "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("m"))
    return summed.groupBy("s").applyInPandas(solved, "s string, fits array<struct<n:double,coef:array<double>,intercept:double>>")


def segment_weights(df: DataFrame, models: Sequence[str], target: str, weight: str, segment: str, moments: CellMoments,
                    min_rows: int = 300, method: str = "ridge_pos", out: str = "seg") -> DataFrame:
    """Add ``out``: nested weights per segment; a thin training segment falls back to the global weights."""
    cells = sorted(moments.cells)
    overall = fit_cells(moments, METHODS[method])
    fits = lookup(segment_fits(df, models, target, weight, segment, cells, method).withColumnRenamed("s", "_s"))
    joined = df.join(fits, F.coalesce(F.col(segment).cast("string"), F.lit("nan")) == F.col("_s"), "left")
    x = F.array(*[F.col(m).cast("double") for m in models])
    parts = []
    for r in moments.repeats:
        value = F.lit(None).cast("double")
        for f in moments.folds_of(r):
            own = F.get("fits", F.lit(cells.index((r, f))))
            local = F.aggregate(F.zip_with(x, own["coef"], lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) + own["intercept"]
            value = F.when(F.col("folds")[r] == f, F.when(own["n"] >= min_rows, local).otherwise(dot(models, *overall[r, f]))).otherwise(value)
        parts.append(value)
    return joined.withColumn(out, clip(add_all(parts) / len(parts))).drop("_s", "fits")


# ---- row-wise families -----------------------------------------------------------

POWERS = (-2.0, -1.0, 0.5, 2.0, 3.0)


def power_name(p: float) -> str:
    return f"power_{p:g}".replace(".", "p")


def family(models: Sequence[str]) -> dict[str, Column]:
    """Arithmetic, geometric, power, median and trimmed means of a member list."""
    k = len(models)
    arr = F.array_sort(F.array(*[clip(m) for m in models]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    floor = 1e-6
    out = {
        "arithmetic": total(arr) / k,
        "geometric": F.exp(F.aggregate(arr, F.lit(0.0), lambda s, x: s + F.log(F.greatest(x, F.lit(floor)))) / k),
        "median": (arr[(k - 1) // 2] + arr[k // 2]) / 2.0,
    }
    for p in POWERS:
        out[power_name(p)] = F.pow(_power_sum(arr, p, floor) / k, F.lit(1.0 / p))
    for t in (1, 2):
        if k > 2 * t:
            out[f"trimmed_{t}"] = total(F.slice(arr, t + 1, k - 2 * t)) / (k - 2 * t)
    return {n: clip(c) for n, c in out.items()}


def _power_sum(arr: Column, p: float, floor: float) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + F.pow(F.greatest(x, F.lit(floor)), F.lit(p)))


def apply_weights(df: DataFrame, models: Sequence[str], coef: Sequence[float], intercept: float, out: str = "pred") -> DataFrame:
    return df.withColumn(out, clip(dot(models, coef, intercept)))
