"""Profiling, quality and drift reports: one aggregate pass per report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textexpr import fold_case, fold_case_py, has_digit, word_count
from .ranks import cumulative, exact_quantiles


def melt(df: DataFrame, metrics: Mapping[str, Column], name: str = "column", value: str = "value") -> DataFrame:
    """Compute many scalars in one aggregate and return them as (name, value) rows."""
    return df.agg(*[c.alias(n) for n, c in metrics.items()]).unpivot([], [F.col(f"`{n}`") for n in metrics], name, value)


def non_null_counts(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    return melt(df, {c: F.count(c) for c in columns}, value=out)


def schema_difference(train: DataFrame, test: DataFrame) -> DataFrame:
    """Columns present on one side only, with the number of values they hold."""
    a = non_null_counts(train, train.columns, "n_train")
    b = non_null_counts(test, test.columns, "n_test")
    both = a.join(b, "column", "full_outer")
    side = F.when(F.col("n_test").isNull(), "train_only").otherwise("test_only")
    return both.filter(F.col("n_test").isNull() | F.col("n_train").isNull()).select(
        "column", side.alias("side"), F.coalesce("n_train", "n_test").alias("n_values"))


def target_profile(df: DataFrame, target: str, cap: float = 100.0, low: float = 50.0, domain=(0.0, 100.0)) -> DataFrame:
    """Moments (both divisors), extremes, median, skew, excess kurtosis, tail shares."""
    y = F.col(target)
    stats = df.agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std_pop"), F.stddev_samp(y).alias("std_samp"),
        F.var_samp(y).alias("var_samp"), F.min(y).alias("min"), F.max(y).alias("max"),
        F.skewness(y).alias("skew"), F.kurtosis(y).alias("kurtosis"),
        (100.0 * F.avg((y >= cap).cast("double"))).alias("pct_cap"), (100.0 * F.avg((y <= low).cast("double"))).alias("pct_low"),
        F.sum((y <= 0).cast("long")).alias("n_zero"),
    )
    return stats.select("*", exact_quantiles(df, target, [0.5], (), domain).scalar().alias("median"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width counts between the smallest and the largest value."""
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    width = (ends["hi"] - ends["lo"]) / F.lit(float(bins))
    slot = F.least(F.floor((F.col(value) - ends["lo"]) / width), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).isNotNull()).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, value: str, domain=None) -> DataFrame:
    c = cumulative(df, value, domain=domain)
    return c.select(value, (F.col("cum_n") / F.col("total_n")).alias("cdf"))


def missing_map(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing counts and percentages of both sides."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        counts = {c: F.struct(F.sum(F.col(c).isNull().cast("long")).alias("n"), (100.0 * F.avg(F.col(c).isNull().cast("double"))).alias("p")) for c in columns}
        return melt(df, counts).select("column", F.col("value.n").alias(f"n_missing_{tag}"), F.col("value.p").alias(f"pct_missing_{tag}"))
    return side(train, "train").join(side(test, "test"), "column", "full_outer")


def mnar_test(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Is a column missing mostly where its related count is zero?"""
    rows = {}
    for c, related in pairs.items():
        zero = (F.coalesce(F.col(related), F.lit(-1.0)) == 0).cast("double")
        rows[c] = F.struct(
            F.avg(zero).alias("overall"), F.avg(F.when(F.col(c).isNull(), zero)).alias("given_null"))
    overall, given = F.col("value.overall"), F.col("value.given_null")
    return melt(df, rows).select(
        "column", overall.alias("zero_overall"), given.alias("zero_given_null"),
        F.coalesce((given > 2 * overall) & (given > 0.5), F.lit(False)).alias("mnar"))


def same_mask(df: DataFrame, a: str, b: str, related: str) -> DataFrame:
    """Do two columns share one null mask, and how often is the related count positive there?"""
    gap = F.col(a).isNull()
    return df.agg(
        F.bool_and(gap == F.col(b).isNull()).alias("same_mask"), F.sum(gap.cast("long")).alias("n_missing"),
        (100.0 * F.avg(F.when(gap, (F.coalesce(F.col(related), F.lit(0.0)) > 0).cast("double")))).alias("pct_related"))


def category_levels(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Levels per side and levels seen on one side only."""
    tagged = train.select(*columns, F.lit(1).alias("tr"), F.lit(0).alias("te")).unionByName(
        test.select(*columns, F.lit(0).alias("tr"), F.lit(1).alias("te")))
    seen = tagged.unpivot(["tr", "te"], list(columns), "column", "level").filter(F.col("level").isNotNull()).groupBy(
        "column", "level").agg(F.max("tr").alias("tr"), F.max("te").alias("te"))
    return seen.groupBy("column").agg(
        F.sum("tr").alias("n_train"), F.sum("te").alias("n_test"),
        F.sum((F.col("te") == 0).cast("long")).alias("n_train_only"), F.sum((F.col("tr") == 0).cast("long")).alias("n_test_only"))


def correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pairwise-complete Pearson correlation with the target."""
    return melt(df, {c: F.corr(c, target) for c in columns}, value="corr")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = {f"{a}|{b}": F.corr(a, b) for i, a in enumerate(columns) for b in columns[i:]}
    parts = F.split("pair", r"\|")
    return melt(df, pairs, "pair", "corr").select(parts[0].alias("a"), parts[1].alias("b"), "corr")


def value_counts(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    a = train.groupBy(column).agg(F.count("*").alias("n_train"))
    b = test.groupBy(column).agg(F.count("*").alias("n_test"))
    return a.join(b, column, "full_outer").select(
        column, F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("n_test", F.lit(0)).alias("n_test"))


def cohort_drift(df: DataFrame, cohort: str, target: str) -> DataFrame:
    """Target mean per cohort next to the largest difference between cohorts."""
    means = df.groupBy(cohort).agg(F.avg(target).alias("mean"), F.count("*").alias("n"))
    drift = means.agg(F.max("mean") - F.min("mean")).scalar()
    return means.select(cohort, "n", "mean", drift.alias("drift"))


def share_shift(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    c = value_counts(train, test, column)
    total = c.agg(F.struct(F.sum("n_train").alias("a"), F.sum("n_test").alias("b"))).scalar()
    pa, pb = 100.0 * F.col("n_train") / total["a"], 100.0 * F.col("n_test") / total["b"]
    return c.select(column, pa.alias("pct_train"), pb.alias("pct_test"), F.abs(pa - pb).alias("abs_diff"))


def text_profile(df: DataFrame, text: str, groups: Sequence[str] = ()) -> DataFrame:
    w, n = word_count(text), F.length(text)
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(w).alias("words_mean"), F.min(w).alias("words_min"), F.max(w).alias("words_max"),
        F.avg(n).alias("chars_mean"), F.min(n).alias("chars_min"), F.max(n).alias("chars_max"),
        F.countDistinct(text).alias("n_distinct"), F.sum(has_digit(text).cast("long")).alias("n_digit"))


def keyword_frequency(df: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    """Rows whose folded text contains the keyword."""
    low = fold_case(text)
    return melt(df, {k: F.sum(low.contains(fold_case_py(k)).cast("long")) for k in keywords}, "keyword", "n_rows")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct non-null values per column, deduplicated before they are counted."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "v")
    return long.filter(F.col("v").isNotNull()).distinct().groupBy("column").agg(F.count("*").alias("nunique"))


def column_profile(train: DataFrame, test: DataFrame, roles: Mapping[str, str], numeric: Sequence[str], target: str) -> DataFrame:
    columns = list(roles)
    role = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    return (
        missing_map(train, test, columns).join(distinct_counts(train, columns), "column", "left")
        .join(correlations(train, numeric, target), "column", "left")
        .withColumn("role", role[F.col("column")])
    )


def check_expectations(metrics: DataFrame, expected: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Compare (label, value) rows with recorded values: PASS within the tolerance, else WARN."""
    spark = metrics.sparkSession
    table = spark.createDataFrame(list(expected), "label string, ref double, tol double")
    return metrics.join(F.broadcast(table), "label").select(
        "label", "value", "ref", "tol",
        F.when(F.abs(F.col("value") - F.col("ref")) <= F.col("tol"), "PASS").otherwise("WARN").alias("status"))


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean and whether the column looks like a 0-100 score."""
    stats = {c: F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.avg(c).alias("mean")) for c in columns}
    lo, hi = F.col("value.lo"), F.col("value.hi")
    return melt(df, stats).select(
        "column", lo.alias("lo"), hi.alias("hi"), F.col("value.mean").alias("mean"),
        ((hi <= 100.5) & (lo >= -0.5) & (hi > 10)).alias("score_like"))


def segment_summary(df: DataFrame, segment: Sequence[str], target: str) -> DataFrame:
    return df.groupBy(*segment).agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"), F.count("*").alias("n"))


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule; an unknown outcome is not a violation."""
    return melt(df, {n: F.sum(F.coalesce(c, F.lit(False)).cast("long")) for n, c in rules.items()}, "rule", "n_violations")


def segment_signature(df: DataFrame, segment: str, columns: Sequence[str]) -> DataFrame:
    """Distance of each segment mean from the population mean in population deviations."""
    whole = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])).scalar()
    means = df.groupBy(segment).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
    z = means.select(segment, "n", *[((F.col(c) - whole[f"m_{c}"]) / F.nullif(whole[f"s_{c}"], F.lit(0.0))).alias(c) for c in columns])
    return z.unpivot([segment, "n"], list(columns), "column", "z")
