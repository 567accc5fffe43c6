"""Small dense solvers for statistics that were already summed on the cluster.

Every matrix here has the size of the feature list, never of the data.
"""

from __future__ import annotations

import math

import numpy as np


def ridge_from_moments(m: np.ndarray, alpha: float, intercept: bool = True):
    """Ridge from the moment matrix of ``[1, x..., y]``; returns (coef, intercept)."""
    n = m[0, 0]
    xtx, xty = m[1:-1, 1:-1], m[1:-1, -1]
    if not intercept:
        return np.linalg.solve(xtx + alpha * np.eye(len(xtx)), xty), 0.0
    mx, my = m[0, 1:-1] / n, m[0, -1] / n
    a = xtx - n * np.outer(mx, mx) + alpha * np.eye(len(xtx))
    b = xty - n * mx * my
    coef = np.linalg.lstsq(a, b, rcond=None)[0] if alpha == 0 else np.linalg.solve(a, b)
    return coef, float(my - mx @ coef)


def nonnegative_quadratic(a: np.ndarray, b: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """argmin 1/2 x'Ax - b'x with x >= 0, by growing and shrinking the free set."""
    k = len(b)
    x = np.zeros(k)
    free = np.zeros(k, dtype=bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(50 * max(k, 1)):
        slope = np.where(free, -np.inf, b - a @ x)
        j = int(np.argmax(slope))
        if slope[j] <= tol * scale:
            break
        free[j] = True
        while True:
            idx = np.flatnonzero(free)
            trial = np.linalg.lstsq(a[np.ix_(idx, idx)], b[idx], rcond=None)[0]
            if trial.min() > 0:
                x[:] = 0.0
                x[idx] = trial
                break
            current = x[idx]
            blocked = trial <= 0
            step = np.min(current[blocked] / np.maximum(current[blocked] - trial[blocked], 1e-300))
            moved = current + step * (trial - current)
            moved[np.isclose(moved, 0.0, atol=1e-14) | (moved < 0)] = 0.0
            x[idx] = moved
            newly = idx[moved == 0.0]
            if len(newly) == 0:
                newly = idx[[int(np.argmin(moved))]]
                x[newly] = 0.0
            free[newly] = False
            if not free.any():
                break
    return x


def nnls_from_moments(m: np.ndarray):
    """Non-negative least squares without intercept from the moments of [1, x, y]."""
    return nonnegative_quadratic(m[1:-1, 1:-1], m[1:-1, -1]), 0.0


def ridge_pos_from_moments(m: np.ndarray, alpha: float = 1.0):
    """Ridge with coefficients >= 0 and a free intercept."""
    n = m[0, 0]
    mx, my = m[0, 1:-1] / n, m[0, -1] / n
    a = m[1:-1, 1:-1] - n * np.outer(mx, mx) + alpha * np.eye(len(mx))
    b = m[1:-1, -1] - n * mx * my
    coef = nonnegative_quadratic(a, b)
    return coef, float(my - mx @ coef)


def elastic_net_from_moments(
    m: np.ndarray, alpha: float, l1_ratio: float, positive: bool = False, sweeps: int = 5000
):
    """Coordinate descent on 1/(2n)|y-Xw|^2 + alpha*(l1*|w| + (1-l1)/2*|w|^2)."""
    n = m[0, 0]
    mx, my = m[0, 1:-1] / n, m[0, -1] / n
    a = m[1:-1, 1:-1] / n - np.outer(mx, mx)
    b = m[1:-1, -1] / n - mx * my
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    w = np.zeros(len(b))
    for _ in range(sweeps):
        biggest = 0.0
        for j in range(len(b)):
            rest = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (a[j, j] + l2 + 1e-300)
            if positive:
                new = max(new, 0.0)
            biggest = max(biggest, abs(new - w[j]))
            w[j] = new
        if biggest < 1e-12:
            break
    return w, float(my - mx @ w)


def bayes_ridge_from_moments(m: np.ndarray, rounds: int = 300):
    """Evidence-maximising ridge: noise and weight precision are re-estimated in turn."""
    n = m[0, 0]
    mx, my = m[0, 1:-1] / n, m[0, -1] / n
    a = m[1:-1, 1:-1] - n * np.outer(mx, mx)
    b = m[1:-1, -1] - n * mx * my
    yy = m[-1, -1] - n * my * my
    eig = np.maximum(np.linalg.eigvalsh(a), 0.0)
    noise, prior = n / max(yy, 1e-12), 1.0
    w = np.zeros(len(b))
    for _ in range(rounds):
        w_new = np.linalg.solve(a + (prior / noise) * np.eye(len(b)), b)
        rss = max(yy - 2 * w_new @ b + w_new @ a @ w_new, 1e-12)
        dof = float(np.sum(noise * eig / (prior + noise * eig)))
        prior = (dof + 2e-6) / (w_new @ w_new + 2e-6)
        noise = (n - dof + 2e-6) / (rss + 2e-6)
        if np.abs(w_new - w).sum() < 1e-10:
            w = w_new
            break
        w = w_new
    return w, float(my - mx @ w)


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        half = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = half * (b - half) * x / ((a + 2 * half - 1) * (a + 2 * half))
        else:
            num = -(a + half) * (a + b + half) * x / ((a + 2 * half) * (a + 2 * half + 1))
        d = 1.0 / max(1.0 + num * d, tiny) if 1.0 + num * d > 0 else 1.0 / min(1.0 + num * d, -tiny)
        c = 1.0 + num / c if abs(c) > tiny else 1.0 + num / tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def student_t_two_sided(t: float, df: int) -> float:
    """P(|T| >= |t|) of Student's t distribution."""
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.vectorize(math.erf)(np.asarray(x, dtype=float) / math.sqrt(2.0)))


def normal_pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2.0 * math.pi)
