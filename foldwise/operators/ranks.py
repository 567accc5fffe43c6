"""Exact ranks, running sums and quantiles without a single-task sort.

Rows are first collapsed to distinct values (a value shared by a third of the
rows becomes one row), distinct values are spread over range buckets, every bucket
is summed on its own, and the bucket offsets (at most ``buckets`` rows per group)
are added back.  Bucket borders only steer the partitioning; results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rowwise import add_all
from ..session import default_buckets, stored

Domain = tuple[float, float] | None


def _with_bucket(df: DataFrame, value: str, domain: Domain, buckets: int) -> DataFrame:
    if domain is not None:
        lo, hi = domain
        step = (F.col(value).cast("double") - F.lit(float(lo))) * F.lit(buckets / float(hi - lo))
        return df.withColumn(
            "_b", F.least(F.greatest(F.floor(step), F.lit(0)), F.lit(buckets - 1)).cast("int")
        )
    probs = [i / buckets for i in range(1, buckets)]
    borders = sorted(set(df.select(F.col(value).cast("double")).approxQuantile(value, probs, 0.25 / buckets)))
    if not borders:
        return df.withColumn("_b", F.lit(0))
    splits = [-float("inf"), *borders, float("inf")]
    numbered = df.withColumn("_v", F.col(value).cast("double"))
    return (
        Bucketizer(splits=splits, inputCol="_v", outputCol="_bd")
        .transform(numbered)
        .withColumn("_b", F.col("_bd").cast("int"))
        .drop("_v", "_bd")
    )


def cumulative(
    df: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    measures: Mapping[str, Column] | None = None,
    domain: Domain = None,
    buckets: int | None = None,
) -> DataFrame:
    """Distinct values with ``<m>``, inclusive running sum ``cum_<m>`` and ``total_<m>``.

    ``measures`` maps a name to the per-row amount to add (default: a row count ``n``).
    """
    measures = dict(measures or {"n": F.lit(1)})
    groups = list(groups)
    buckets = buckets or default_buckets(df.sparkSession)
    distinct = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    )
    placed = _with_bucket(distinct, value, domain, buckets)
    inside = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.select(
        "*", *[F.sum(m).over(inside).alias(f"_in_{m}") for m in measures]
    )
    part = groups or [F.lit(0)]
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    offsets = (
        placed.groupBy(*groups, "_b")
        .agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
        .select(
            *groups, "_b",
            *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
            *[F.sum(f"_s_{m}").over(whole).alias(f"total_{m}") for m in measures],
        )
    )
    return running.join(offsets, [*groups, "_b"]).select(
        *groups, value, *measures,
        *[(F.col(f"_in_{m}") + F.col(f"_o_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def row_numbers(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    tie: str,
    domain: Domain,
    out: str = "rn",
    buckets: int | None = None,
) -> DataFrame:
    """``row_number() over (partition by groups order by order, tie)`` spread over buckets.

    ``order`` must be spread evenly over ``domain`` (a keyed hash).
    """
    groups = list(groups)
    buckets = buckets or default_buckets(df.sparkSession)
    placed = _with_bucket(df, order, domain, buckets)
    inside = Window.partitionBy(*groups, "_b").orderBy(order, tie)
    part = groups or [F.lit(0)]
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*groups, "_b")
        .agg(F.count("*").alias("_s"))
        .select(*groups, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    )
    return (
        placed.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [*groups, "_b"])
        .withColumn(out, F.col("_in") + F.col("_o"))
        .drop("_in", "_o", "_b")
    )


def sorted_numbers(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), out: str = "code") -> DataFrame:
    """Number rows from 0 along ``order`` (any sortable columns, after ``groups``) by a range sort.

    Every sorted part numbers its own rows; the parts' sizes, one row each, give where a
    part starts. No task holds a whole group.
    """
    rows = stored(df.orderBy(*groups, *order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    whole = rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")  # one row per part: bounded by the shuffle width
    whole = whole.withColumn(out, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start")
    if not groups:
        return whole
    first = whole.groupBy(*groups).agg(F.min(out).alias("_first"))
    return whole.join(first, list(groups)).withColumn(out, F.col(out) - F.col("_first")).drop("_first")


def quantiles_of_counts(cum: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles ``q0..`` per group from a :func:`cumulative` table."""
    first, aggs = F.col("cum_n") - F.col("n"), []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total_n") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(
                F.max(F.when((first <= at) & (at < F.col("cum_n")), F.col(value).cast("double"))).alias(f"_{side}{i}")
            )
    total = F.max("total_n").alias("_t")
    base = cum.groupBy(*groups).agg(total, *aggs) if groups else cum.agg(total, *aggs)
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_t") - 1)
        out.append(
            (F.col(f"_lo{i}") + (pos - F.floor(pos)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}")
        )
    return base.select(*groups, *out)


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (),
    domain: Domain = None, weights: Column | None = None,
) -> DataFrame:
    """Exact interpolated quantiles, one row per group with columns ``q0..``."""
    measures = {"n": weights if weights is not None else F.lit(1)}
    return quantiles_of_counts(cumulative(df, value, groups, measures, domain), value, probs, groups)


def training_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (), domain: Domain = None,
    n_repeats: int = 3, n_folds: int = 5, digits: int | None = None,
) -> DataFrame:
    """Exact quantiles of every cell's training rows: (repeat, fold, groups, q0..), from ``df(folds, value, *groups)``.

    A distinct value is one row with the counts of all cells and their running
    sums; how many training rows of a cell lie at or below a value is the repeat's
    running sum minus the cell's, so nothing is repeated per cell.
    """
    groups = list(groups)
    cells = [(r, f) for r in range(n_repeats) for f in range(n_folds)]
    counts = {f"c{r}_{f}": F.coalesce((F.col("folds")[r] == f).cast("long"), F.lit(0)) for r, f in cells}
    cum = cumulative(df, value, groups, counts, domain)

    arrays = [F.array(*[F.col(f"{p}{c}") for c in counts]).alias(n) for p, n in (("", "n"), ("cum_", "cum"), ("total_", "total"))]
    slim = cum.select(*groups, F.col(value).cast("double").alias("v"), *arrays)
    repeat_of, points = np.array([r for r, _ in cells]), list(probs)

    def outside(batch: pa.RecordBatch, name: str) -> np.ndarray:
        """Counts of every cell's training rows: the repeat's total minus the cell."""
        own = np.asarray(batch.column(name).flatten()).reshape(batch.num_rows, len(cells))
        return own.reshape(-1, n_repeats, n_folds).sum(axis=2)[:, repeat_of] - own

    def at_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The values at the two positions around every quantile: a few rows per group and cell in all."""
        for batch in batches:
            n, upto, total = (outside(batch, c) for c in ("n", "cum", "total"))
            rows, cell, point, side = ([] for _ in range(4))
            for i, p in enumerate(points):
                pos = p * (total - 1)
                for k, at in enumerate((np.floor(pos), np.ceil(pos))):
                    r, c = np.nonzero((upto - n <= at) & (at < upto) & (total > 0))
                    rows.append(r), cell.append(c), point.append(np.full(len(r), i)), side.append(np.full(len(r), k))
            rows, cell, point, side = (np.concatenate(x) for x in (rows, cell, point, side))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(g).take(pa.array(rows)) for g in groups], pa.array(cell, pa.int32()), pa.array(point, pa.int32()), pa.array(side, pa.int32()),
                 batch.column("v").take(pa.array(rows)), pa.array(total[rows, cell], pa.int64())], names=[*groups, "_cell", "_point", "_side", "_v", "_total"])

    types = dict(slim.dtypes)
    found = slim.mapInArrow(at_positions, ", ".join([*[f"`{g}` {types[g]}" for g in groups], "_cell int, _point int, _side int, _v double, _total long"]))
    ends = [F.max(F.when((F.col("_point") == i) & (F.col("_side") == k), F.col("_v"))).alias(f"_{k}_{i}") for i in range(len(points)) for k in (0, 1)]
    each = found.groupBy(*groups, "_cell").agg(F.max("_total").alias("_total"), *ends)
    out = []
    for i, p in enumerate(points):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        q = F.col(f"_0_{i}") + (pos - F.floor(pos)) * (F.col(f"_1_{i}") - F.col(f"_0_{i}"))
        out.append((q if digits is None else F.round(q, digits)).alias(f"q{i}"))
    repeat, fold = (F.element_at(F.array(*[F.lit(c[i]) for c in cells]), F.col("_cell") + 1) for i in (0, 1))
    return each.select(repeat.alias("repeat"), fold.alias("fold"), *groups, *out)


def rank_table(
    df: DataFrame, value: str, out: str, groups: Sequence[str] = (), domain: Domain = None, percent: bool = False
) -> DataFrame:
    """(groups, value, rank) for every distinct value.

    ``percent`` gives (rank - 1) / (rows - 1) as the SQL window function does;
    otherwise tied rows share their mean position (1-based).
    """
    first = F.col("cum_n") - F.col("n")
    if percent:
        rank = F.when(F.col("total_n") > 1, first / (F.col("total_n") - 1)).otherwise(F.lit(0.0))
    else:
        rank = first + (F.col("n") + 1) / 2.0
    return cumulative(df, value, groups, None, domain).select(*groups, value, rank.alias(out))


def with_ranks(df: DataFrame, specs: Mapping[str, tuple[str, Domain]], groups: Sequence[str] = (), percent: bool = False) -> DataFrame:
    """Attach several ranks ``{out: (value, domain)}``; all are taken from the same input.

    The join back is on the value itself; adaptive execution splits a hot value.
    """
    out = df
    for name, (value, domain) in specs.items():
        out = out.join(rank_table(df, value, name, groups, domain, percent), [*groups, value], "left")
    return out


def quantile_edges(
    df: DataFrame, value: str, bins: int, domain: Domain = None, digits: int = 6
) -> list[float]:
    """Inner edges of equal-frequency bins, duplicates dropped (``bins - 1`` numbers at most)."""
    probs = [i / bins for i in range(bins + 1)]
    row = exact_quantiles(df, value, probs, (), domain).first()
    edges = [round(v, digits) for v in row if v is not None]
    return sorted({e for e in edges if e > edges[0] and e < edges[-1]}) if edges else []


def bin_of(value: str | Column, edges: Sequence[float]) -> Column:
    """Right-closed bin number: how many inner edges lie strictly below the value."""
    c = F.col(value) if isinstance(value, str) else value
    if not edges:
        return F.when(c.isNotNull(), 0).cast("int")
    return add_all([(c > F.lit(float(e))).cast("int") for e in edges])


