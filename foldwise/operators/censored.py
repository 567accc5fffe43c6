"""Right-censored Gaussian regression fitted by Newton steps on summed derivatives."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.solvers import normal_cdf, normal_pdf


def _tail_ratio(v: np.ndarray) -> np.ndarray:
    """phi / Phi, with its limit far in the lower tail."""
    out = -v - 1.0 / np.minimum(v, -1.0)
    near = v > -8.0
    out[near] = normal_pdf(v[near]) / normal_cdf(v[near])
    return out


def fit_censored(df: DataFrame, columns: Sequence[str], target: str, cap: float = 100.0, steps: int = 12):
    """Maximum likelihood of min(latent, cap); returns (beta, intercept, sigma, log-likelihood).

    In the parameters (beta / sigma, 1 / sigma) the likelihood is concave.  Each step
    is one distributed aggregate of gradient, curvature and value; the driver solves a
    system of the size of the column list and halves steps that do not improve.
    """
    k = len(columns) + 1
    rows = df.select(F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns]).alias("x"), F.col(target).cast("double").alias("y")).persist()

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        gamma, inv = theta[:k], theta[k]

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            value, grad, hess = 0.0, np.zeros(k + 1), np.zeros((k + 1, k + 1))
            for b in batches:
                if b.empty:
                    continue
                x, y = np.vstack(b.x.to_numpy()), b.y.to_numpy()
                free = y < cap
                z, u = np.column_stack([x[free], -y[free]]), inv * y[free] - x[free] @ gamma
                value += free.sum() * np.log(inv) - 0.5 * (u * u).sum() - 0.5 * np.log(2 * np.pi) * free.sum()
                grad += z.T @ u
                grad[k] += free.sum() / inv
                hess -= z.T @ z
                hess[k, k] -= free.sum() / inv**2
                zc = np.column_stack([x[~free], np.full((~free).sum(), -cap)])
                v = zc @ theta
                if len(v):
                    lam = _tail_ratio(v)
                    value += np.log(np.maximum(normal_cdf(v), 1e-300)).sum()
                    grad += zc.T @ lam
                    hess += zc.T @ (zc * (-lam * (lam + v))[:, None])
            yield pd.DataFrame({"v": [np.concatenate([[value], grad, hess.ravel()])]})

        got = rows.mapInPandas(partial, "v array<double>").select(F.posexplode("v").alias("p", "s")).groupBy("p").agg(F.sum("s").alias("s")).collect()
        flat = np.zeros(1 + (k + 1) + (k + 1) ** 2)
        for r in got:
            flat[r["p"]] = r["s"]
        return flat[0], flat[1:k + 2], flat[k + 2:].reshape(k + 1, k + 1)

    start = df.agg(F.avg(target).alias("m"), F.stddev_pop(target).alias("s")).first()
    theta = np.zeros(k + 1)
    theta[0], theta[k] = start["m"] / start["s"], 1.0 / start["s"]
    value, grad, hess = sums(theta)
    for _ in range(steps):
        step = np.linalg.solve(hess - 1e-9 * np.eye(k + 1), -grad)
        scale = 1.0
        while theta[k] + scale * step[k] <= 0:
            scale /= 2
        for _ in range(6):
            trial = sums(theta + scale * step)
            if trial[0] >= value - 1e-9:
                break
            scale /= 2
        gain, theta = trial[0] - value, theta + scale * step
        value, grad, hess = trial
        if abs(gain) < 1e-6 * max(1.0, abs(value)) * 1e-3:
            break
    rows.unpersist()
    sigma = 1.0 / theta[k]
    return theta[1:k] * sigma, float(theta[0] * sigma), float(sigma), float(value)


def expected_below_cap(mu: Column, sigma: float, cap: float = 100.0) -> Column:
    """E[min(N(mu, sigma), cap)] per row."""

    @F.pandas_udf("double")
    def expect(m: pd.Series) -> pd.Series:
        mean = m.to_numpy(dtype=float)
        z = (cap - mean) / sigma
        return pd.Series(mean * normal_cdf(z) - sigma * normal_pdf(z) + cap * (1.0 - normal_cdf(z)))

    return expect(mu)
