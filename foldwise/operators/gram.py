"""Shared second moments: one pass over the rows serves every fold, subset and penalty.

``cell_moments`` sums the matrix of ``[1, x..., y]`` per (repeat, fold) cell; the
training matrix of a cell is the repeat total minus the cell.  Rows carry their
fold numbers as an array, so nothing is repeated per repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import add_all, clip, dot
from .folds import fold_array

Solver = Callable[[np.ndarray], tuple[np.ndarray, float]]


def with_fold_array(df: DataFrame, folds: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(fold_array(folds, key), key)


@dataclass
class CellMoments:
    """Moment matrices by (repeat, fold); row 0 is the constant, the last row the target."""

    names: list[str]
    cells: dict[tuple[int, int], np.ndarray]

    @property
    def repeats(self) -> list[int]:
        return sorted({r for r, _ in self.cells})

    def folds_of(self, repeat: int) -> list[int]:
        return sorted(f for r, f in self.cells if r == repeat)

    def total(self, repeat: int = 0) -> np.ndarray:
        return sum(m for (r, _), m in self.cells.items() if r == repeat)

    def training(self, repeat: int, fold: int) -> np.ndarray:
        return self.total(repeat) - self.cells[(repeat, fold)]

    def subset(self, names: Sequence[str]) -> "CellMoments":
        """Keep only some columns: a submatrix, no new pass."""
        keep = [0, *[1 + self.names.index(n) for n in names], len(self.names) + 1]
        return CellMoments(list(names), {c: m[np.ix_(keep, keep)] for c, m in self.cells.items()})


def cell_moments(df: DataFrame, columns: Sequence[str] | Column, target: str, weight: str | None = None,
                 folds: str = "folds", names: Sequence[str] | None = None) -> CellMoments:
    """Sum the (weighted) moments per cell.

    ``columns`` is a list of columns or one array column.  Every task keeps one
    matrix per cell and emits it once; matrices are added up by position.
    """
    vec = F.array(*[F.col(c).cast("double") for c in columns]) if not isinstance(columns, Column) else columns.cast("array<double>")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(vec.alias("x"), F.col(target).cast("double").alias("y"), w.alias("w"), F.col(folds).alias("f"))

    def plain(column: pa.Array) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False)

    def stacked(column: pa.ListArray) -> np.ndarray:
        """Lists of equal length as the rows of a matrix."""
        sizes = np.diff(plain(column.offsets))
        if column.null_count or (sizes != sizes[0]).any():
            raise ValueError("all rows need lists of the same length")
        return plain(column.flatten()).reshape(len(column), sizes[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            z = np.column_stack([np.ones(b.num_rows), stacked(b.column("x")), plain(b.column("y"))])
            wz, f = z * plain(b.column("w"))[:, None], stacked(b.column("f"))
            for r in range(f.shape[1]):
                for v in np.unique(f[:, r]):
                    at = f[:, r] == v
                    m = wz[at].T @ z[at]
                    acc[(r, int(v))] = acc.get((r, int(v)), 0.0) + m
        for (r, v), m in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([v], pa.int32()), pa.array([m.ravel()], pa.list_(pa.float64()))], names=["repeat", "fold", "m"])

    summed = (
        rows.mapInArrow(partial, "repeat int, fold int, m array<double>")
        .select("repeat", "fold", F.posexplode("m").alias("pos", "v"))
        .groupBy("repeat", "fold", "pos").agg(F.sum("v").alias("v"))
        .groupBy("repeat", "fold").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m"))
    )
    cells = {}
    for r in summed.collect():
        flat = np.array([e["v"] for e in r["m"]])
        side = int(round(len(flat) ** 0.5))
        cells[(r["repeat"], r["fold"])] = flat.reshape(side, side)
    if names is None:
        side = next(iter(cells.values())).shape[0] - 2
        names = list(columns) if not isinstance(columns, Column) else [f"x{i}" for i in range(side)]
    return CellMoments(list(names), cells)


def fit_cells(moments: CellMoments, solve: Solver) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """Solve every cell from its training moments."""
    return {(r, f): solve(moments.training(r, f)) for r, f in moments.cells}


def held_out_column(columns: Sequence[str], fitted: dict[tuple[int, int], tuple[np.ndarray, float]], folds: str = "folds") -> Column:
    """Mean over repeats of the linear prediction by the cell that held the row out."""
    repeats = sorted({r for r, _ in fitted})
    per_repeat = []
    for r in repeats:
        arms = F.lit(None).cast("double")
        for f in sorted(f for rr, f in fitted if rr == r):
            coef, intercept = fitted[(r, f)]
            arms = F.when(F.col(folds)[r] == f, dot(columns, coef, intercept)).otherwise(arms)
        per_repeat.append(arms)
    return add_all(per_repeat) / len(per_repeat)


def held_out_vector(vector: str, fitted: dict[tuple[int, int], tuple[np.ndarray, float]], folds: str = "folds") -> Column:
    """The same for long array columns, by matrix products inside the tasks."""
    repeats = sorted({r for r, _ in fitted})
    k = 1 + max(f for _, f in fitted)
    coef = np.array([[fitted[(r, f)][0] for f in range(k)] for r in repeats])
    inter = np.array([[fitted[(r, f)][1] for f in range(k)] for r in repeats])

    @F.pandas_udf("double")
    def score(x: pd.Series, f: pd.Series) -> pd.Series:
        m, at = np.vstack(x.to_numpy()).astype(float), np.vstack(f.to_numpy())
        out = np.zeros(len(m))
        for r in range(len(repeats)):
            out += (m * coef[r][at[:, r]]).sum(1) + inter[r][at[:, r]]
        return pd.Series(out / len(repeats))

    return score(F.col(vector).cast("array<double>"), F.col(folds))


def linear_vector(vector: str, coef: np.ndarray, intercept: float) -> Column:
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(np.vstack(x.to_numpy()).astype(float) @ coef + intercept)

    return score(F.col(vector).cast("array<double>"))


def weighted_score(df: DataFrame, preds: dict[str, Column], target: str, weight: str | None) -> dict[str, float]:
    """(weighted) MSE after clipping of many candidate predictions in one pass."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    aggs = []
    for n, p in preds.items():
        d = F.col(target) - clip(p)
        aggs.append((F.sum(w * d * d) / F.sum(w)).alias(n))
    row = df.agg(*aggs).first()
    return {n: float(row[n]) for n in preds}


def ols_report(moments: CellMoments, names: Sequence[str] | None = None) -> dict[str, object]:
    """Least squares on all rows: coefficients (raw and standardised), R2, residual deviation."""
    from ..functions.solvers import ridge_from_moments

    cm = moments.subset(names) if names is not None else moments
    m = cm.total()
    n = m[0, 0]
    coef, intercept = ridge_from_moments(m, 0.0)
    mean = m[0] / n
    cov = m / n - np.outer(mean, mean)
    sxx, sxy, syy = cov[1:-1, 1:-1], cov[1:-1, -1], cov[-1, -1]
    rss = max(syy - 2 * coef @ sxy + coef @ sxx @ coef, 0.0)
    return {"coef": coef, "intercept": intercept, "std_coef": coef * np.sqrt(np.maximum(np.diag(sxx), 0.0)), "r2": float(1 - rss / syy), "resid_std": float(np.sqrt(rss)), "n": float(n)}


def cell_basis_ridge(df: DataFrame, basis: Callable[[tuple[int, int]], Sequence[Column]], target: str, alpha: float,
                     cells: Sequence[tuple[int, int]], out: str = "pred") -> DataFrame:
    """Ridge on a basis that is itself fitted per cell (knots, scales): ``out`` is the held-out prediction.

    Each cell sums the moments of its own training rows; a row is then scored by the cells that held it out.
    """
    from ..functions.solvers import ridge_from_moments

    total, repeats = [], sorted({r for r, _ in cells})
    for r in repeats:
        value = F.lit(None).cast("double")
        for c in [c for c in cells if c[0] == r]:
            columns = list(basis(c))
            train = df.filter(F.col("folds")[r] != c[1]).select(F.array(*[x.cast("double") for x in columns]).alias("_x"), target, F.array(F.lit(0)).alias("folds"))
            coef, intercept = ridge_from_moments(cell_moments(train, F.col("_x"), target).total(), alpha)
            weights = F.array(*[F.lit(float(v)) for v in coef])
            score = F.aggregate(F.zip_with(F.array(*[x.cast("double") for x in columns]), weights, lambda a, b: a * b), F.lit(float(intercept)), lambda a, v: a + v)
            value = F.when(F.col("folds")[r] == c[1], score).otherwise(value)
        total.append(value)
    return df.withColumn(out, clip(add_all(total) / len(total)))
