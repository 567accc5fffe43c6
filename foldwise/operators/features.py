"""Deterministic column builders: nothing here learns a statistic from the target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import add_all, missing_flag, row_mean, row_range, row_std, row_sum, smoothed_rate
from ..session import lookup
from ..sources import frame as fr
from .encoders import MISSING_LEVEL, level_list, one_hot
from .folds import CELL, fold_array, with_cells
from .profile import correlations, distinct_counts, melt
from .ranks import training_quantiles, with_ranks


@dataclass(frozen=True)
class Roles:
    """Column roles; every column that is named nowhere is numeric."""

    key: str = fr.KEY
    targets: tuple[str, ...] = (fr.TARGET, fr.PLANTED)
    other: tuple[str, ...] = ("split",)
    text: tuple[str, ...] = ()
    categories: tuple[str, ...] = fr.CATEGORIES
    years: tuple[str, ...] = fr.YEARS
    zero_fill: tuple[str, ...] = fr.ZERO_FILL
    median_fill: tuple[str, ...] = fr.MEDIAN_FILL
    seed: int = 42
    clip: tuple[float, float] = field(default=(0.0, 100.0))

    @property
    def nullable(self) -> tuple[str, ...]:
        return self.zero_fill + self.median_fill


def numeric_columns(columns: Sequence[str], roles: Roles = Roles()) -> list[str]:
    """Numeric features by exclusion of every named role."""
    named = {roles.key, *roles.targets, *roles.other, *roles.text, *roles.categories, *roles.years}
    return [c for c in columns if c not in named]


def category(c: str) -> Column:
    """A category as text; missing is its own level."""
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL))


def clean(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Typed copy: categories as text, years and numerics as doubles; key kept only for joins."""
    passthrough = [c for c in (roles.key, *roles.other, *roles.targets, *roles.text) if c in df.columns]
    return df.select(
        *passthrough,
        *[category(c).alias(c) for c in roles.categories if c in df.columns],
        *[F.col(c).cast("double").alias(c) for c in (*roles.years, *numeric_columns(df.columns, roles)) if c in df.columns],
    )


def structured_matrix(df: DataFrame, roles: Roles = Roles(), flags: bool = True, years: bool = True) -> DataFrame:
    """Numerics, raw years, missing flags and text categories, keyed by row id."""
    return df.select(
        roles.key,
        *[F.col(c).cast("double").alias(c) for c in numeric_columns(df.columns, roles)],
        *([F.col(c).cast("double").alias(c) for c in roles.years] if years else []),
        *([missing_flag(c) for c in roles.nullable] if flags else []),
        *[category(c).alias(c) for c in roles.categories],
    )


def one_hot_matrix(train: DataFrame, df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Structured matrix with categories spread over the training universe."""
    base = structured_matrix(df, roles)
    spread = [e for c in roles.categories for e in one_hot(df, c, level_list(train, c))]
    return base.select(*[c for c in base.columns if c not in roles.categories], *spread)


def column_manifest(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """One-row manifest of the matrix contract plus the observed cardinalities."""
    numeric = [*roles.years, *numeric_columns(df.columns, roles)]
    counts = distinct_counts(df, [*roles.categories, *numeric]).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "nunique")))).alias("cardinality"))
    lit_list = lambda xs: F.array(*[F.lit(x) for x in xs])
    return counts.select(
        F.lit(1).alias("version"), F.lit(roles.seed).alias("seed"), lit_list([roles.key]).alias("drop"),
        F.lit(roles.targets[0]).alias("target"), lit_list(roles.years).alias("year_raw_numeric"),
        lit_list(roles.categories).alias("categorical"), lit_list(numeric).alias("numeric"),
        lit_list(roles.median_fill).alias("median_impute"), lit_list(roles.zero_fill).alias("zero_impute"),
        lit_list([f"{c}_missing" for c in roles.nullable]).alias("missing_flags"),
        lit_list(roles.clip).alias("clip"), "cardinality")


# ---- derived columns -------------------------------------------------------------


@dataclass(frozen=True)
class DerivedSpec:
    """Which columns feed which derived feature."""

    means: Mapping[str, Sequence[str]]
    deviations: Mapping[str, Sequence[str]]
    products: Mapping[str, tuple[str, str]]
    sums: Mapping[str, Sequence[str]]
    strict_sums: Mapping[str, Sequence[str]]
    rates: Mapping[str, tuple[str, str]]
    differences: Mapping[str, tuple[str, str]]
    logs: Sequence[str]


ORDER_SPEC = DerivedSpec(
    means={"qty_mean": ("avg_qty", "ret_qty"), "pts_mean": ("disc_pts", "tax_pts"), "all_mean": fr.SCORE_GROUP},
    deviations={"all_std": fr.SCORE_GROUP, "pts_std": ("disc_pts", "tax_pts")},
    products={"lines_x_qty": ("n_lines", "qty_mean"), "qty_x_pts": ("qty_mean", "pts_mean")},
    sums={"total_counts": ("n_lines", "n_ret")},
    strict_sums={"strict_counts": ("n_lines", "n_ret")},
    rates={"return_rate": ("n_ret", "n_lines")},
    differences={"year_gap": ("ship_year", "cohort_year")},
    logs=("ext_price", "sum_qty"),
)


def derived(df: DataFrame, spec: DerivedSpec = ORDER_SPEC, key: str = fr.KEY) -> DataFrame:
    """All derived columns of a spec keyed by row id, in two projections."""
    means = {n: row_mean(cols) for n, cols in spec.means.items()}
    base = df.select("*", *[c.alias(n) for n, c in means.items()])
    return base.select(
        key, *means,
        *[row_std(cols).alias(n) for n, cols in spec.deviations.items()],
        *[(F.col(a) * F.col(b)).alias(n) for n, (a, b) in spec.products.items()],
        *[row_sum(cols).alias(n) for n, cols in spec.sums.items()],
        *[add_all([F.col(c) for c in cols]).alias(n) for n, cols in spec.strict_sums.items()],
        *[smoothed_rate(a, b).alias(n) for n, (a, b) in spec.rates.items()],
        *[(F.col(a) - F.col(b)).alias(n) for n, (a, b) in spec.differences.items()],
        *[F.log1p(c).alias(f"{c}_log1p") for c in spec.logs],
    )


def add_columns(matrix: DataFrame, extra: DataFrame, columns: Sequence[str], key: str = fr.KEY) -> DataFrame:
    """Attach chosen columns by key; rows without a partner keep NULLs."""
    return matrix.join(extra.select(key, *columns), key, "left")


def profile_shape(df: DataFrame, group: Sequence[str], key: str = fr.KEY) -> DataFrame:
    """Spread of a score group: deviation, mean and range (over non-NULL members)."""
    return df.select(key, row_std(group).alias("shape_std"), row_mean(group).alias("shape_mean"), row_range(group).alias("shape_range"))


def efficiency_ratios(df: DataFrame, pairs: Mapping[str, tuple[str, str]], key: str = fr.KEY) -> DataFrame:
    return df.select(key, *[smoothed_rate(a, b).alias(n) for n, (a, b) in pairs.items()])


def cohort_z(df: DataFrame, columns: Sequence[str], cohorts: Mapping[str, Sequence[str]], key: str = fr.KEY) -> DataFrame:
    """Column minus cohort mean over cohort deviation; cohort tables join by broadcast when small."""
    out = df
    for tag, by in cohorts.items():
        stats = df.groupBy(*by).agg(
            *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
        joined = out.join(lookup(stats), list(by), "left")
        out = joined.select(
            *out.columns, *[((F.col(c) - F.col(f"_m_{c}")) / F.nullif(f"_s_{c}", F.lit(0.0))).alias(f"{c}_z_{tag}") for c in columns])
    return out.select(key, *[f"{c}_z_{t}" for t in cohorts for c in columns])


def cohort_rank(df: DataFrame, value: str, cohort: Sequence[str], out: str, domain=None) -> DataFrame:
    return with_ranks(df, {out: (value, domain)}, cohort, percent=True)


def cell_bins(df: DataFrame, folds: DataFrame, columns: Sequence[str], bins: int = 5, key: str = fr.KEY) -> DataFrame:
    """Held-out rows with each column cut at its training quantiles (right-closed)."""
    rows = df.select(key, *columns).join(fold_array(folds, key), key).unpivot(["folds"], list(columns), "column", "value")
    q = training_quantiles(rows, "value", [i / bins for i in range(bins + 1)], ["column"])
    long = with_cells(df.select(key, *columns), folds, key).unpivot([key, *CELL], list(columns), "column", "value")
    edges = F.array(*[F.round(f"q{i}", 6) for i in range(bins + 1)])
    table = F.broadcast(q.select(*CELL, "column", edges.alias("_e")))
    inner = F.filter(F.array_distinct("_e"), lambda e: (e > F.col("_e")[0]) & (e < F.col("_e")[bins]) & (e < F.col("value")))
    return long.join(table, [*CELL, "column"]).select(
        key, *CELL, "column", F.when(F.col("value").isNotNull(), F.size(inner)).alias("bin"))


def disagreement(df: DataFrame, models: Sequence[str], text: str, numeric: str, key: str = fr.KEY) -> DataFrame:
    """How far the text channel, the numeric channel and the models are apart."""
    centre = row_mean(models)
    return df.select(
        key, F.abs(F.col(text) - F.col(numeric)).alias("text_num_gap"),
        (F.col(text) - F.col(numeric)).alias("text_num_signed"), row_std(models).alias("model_std"),
        *[(F.col(m) - centre).alias(f"{m}_gap") for m in models])


def lattice(df: DataFrame, value: str, key: str = fr.KEY) -> DataFrame:
    """Last decimal digit, quarter-lattice position and frequency of a value."""
    cents = F.round(F.col(value) * 100.0).cast("long")
    freq = df.groupBy(value).agg(F.count("*").alias("value_freq"))
    return df.select(key, value).join(freq, value, "left").select(
        key, F.pmod(cents, F.lit(10)).alias("last_digit"), F.pmod(cents, F.lit(25)).alias("lattice_25"),
        (F.pmod(cents, F.lit(100)) == 0).cast("int").alias("is_integer"), "value_freq")


def pair_scan(df: DataFrame, columns: Sequence[str], target: str, top_columns: int, top_pairs: int) -> DataFrame:
    """Products and ratios of the best-correlated columns, ranked by |corr| with the target."""
    ranked = correlations(df, columns, target).orderBy(F.abs("corr").desc_nulls_last(), "column").limit(top_columns)
    best = sorted(r["column"] for r in ranked.collect())
    metrics: dict[str, Column] = {}
    for i, a in enumerate(best):
        for b in best[i + 1:]:
            metrics[f"{a}*{b}"] = F.corr(F.col(a) * F.col(b), F.col(target))
            metrics[f"{a}/{b}"] = F.corr(F.col(a) / (F.abs(F.col(b)) + 1.0), F.col(target))
    return melt(df, metrics, "pair", "corr").orderBy(F.abs(F.round("corr", 6)).desc_nulls_last(), "pair").limit(top_pairs)
