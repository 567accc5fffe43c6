"""Row-level numeric expressions: null-skipping group statistics, clips, ratios."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP_LO, CLIP_HI = 0.0, 100.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo: float = CLIP_LO, hi: float = CLIP_HI) -> Column:
    """Limit to [lo, hi]; a missing value stays missing, and one that is not finite becomes not-a-number.

    ``least`` and ``greatest`` skip NULL and sort NaN last; the zero product carries both through.
    """
    v = col(c)
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi)) + v * 0.0


def add_all(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def row_sum(cols: Sequence[str]) -> Column:
    """Sum that treats NULL as nothing (0.0 when all are NULL)."""
    return add_all([F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])


def row_count(cols: Sequence[str]) -> Column:
    return add_all([F.col(c).isNotNull().cast("int") for c in cols])


def row_mean(cols: Sequence[str]) -> Column:
    """Mean over the non-NULL members; NULL when there is none."""
    n = row_count(cols)
    return F.when(n > 0, row_sum(cols) / n)


def row_std(cols: Sequence[str]) -> Column:
    """Sample standard deviation over the non-NULL members (NULL below two)."""
    n = row_count(cols)
    m = row_mean(cols)
    ss = add_all(
        [F.coalesce((F.col(c).cast("double") - m) * (F.col(c).cast("double") - m), F.lit(0.0)) for c in cols]
    )
    return F.when(n > 1, F.sqrt(ss / (n - 1)))


def row_range(cols: Sequence[str]) -> Column:
    return F.greatest(*[F.col(c) for c in cols]) - F.least(*[F.col(c) for c in cols])


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    return col(num) / F.nullif(col(den), F.lit(0))


def smoothed_rate(num: str | Column, den: str | Column) -> Column:
    """x / (y + 1): never divides by zero for counts."""
    return col(num) / (col(den) + F.lit(1.0))


def missing_flag(c: str) -> Column:
    return F.col(c).isNull().cast("int").alias(f"{c}_missing")


def squared_error(y: str | Column, p: str | Column) -> Column:
    d = col(y) - col(p)
    return d * d


def dot(cols: Sequence[str], weights: Sequence[float], intercept: float = 0.0) -> Column:
    """Linear combination with literal weights."""
    terms = [F.col(c) * F.lit(float(w)) for c, w in zip(cols, weights)]
    return add_all([F.lit(float(intercept)), *terms])
