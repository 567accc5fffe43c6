"""Choosing, building and auditing published predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import clip
from .metrics import gap_status


def pick_best(ledger: DataFrame, allowed: Sequence[str], score: str = "cv_mean") -> DataFrame:
    return ledger.filter(F.col("model").isin(list(allowed)) & F.col(score).isNotNull()).orderBy(score, "model").limit(1)


def build_submission(canonical: DataFrame, preds: DataFrame, key: str = "row_id", out: str = "score") -> DataFrame:
    """Clipped predictions on the canonical rows; a key with several predictions is visible in ``n_matches``."""
    per_key = preds.groupBy(key).agg(F.first("pred").alias("pred"), F.count("*").alias("n_matches"))
    return canonical.select(key, "ordinal").join(per_key, key, "left").select(key, "ordinal", clip("pred").alias(out), "n_matches")


def submission_violations(sub: DataFrame, canonical: DataFrame, key: str = "row_id", value: str = "score") -> DataFrame:
    """Eight checks as counts; a clean submission has zeros only."""
    a = sub.groupBy(key).agg(F.count("*").alias("n"), F.max(F.struct("ordinal", value, "n_matches")).alias("s"))
    b = canonical.groupBy(key).agg(F.count("*").alias("m"), F.max("ordinal").alias("o"))
    v = F.col(f"s.{value}")
    both = a.join(b, key, "full_outer")
    flags = {
        "missing_key": F.col("n").isNull(), "unknown_key": F.col("m").isNull(), "duplicate_key": F.col("n") > 1,
        "null_value": F.col("n").isNotNull() & v.isNull(), "not_finite": F.isnan(v) | (F.abs(v) == float("inf")),
        "out_of_range": (v < 0) | (v > 100), "wrong_order": F.col("s.ordinal") != F.col("o"), "many_predictions": F.col("s.n_matches") > 1,
    }
    return both.agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in flags.items()])


def mean_difference(a: DataFrame, b: DataFrame, key: str = "row_id", value: str = "score") -> DataFrame:
    d = F.abs(F.col(value) - F.col("_o"))
    return a.select(key, value).join(b.select(key, F.col(value).alias("_o")), key).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_abs_diff"), F.max(d).alias("max_abs_diff"))


def artifact_audit(store: DataFrame, train: DataFrame, recomputed: DataFrame, ledger: DataFrame, key: str = "row_id",
                   drift_limit: float = 5.0, tol: float = 1e-6) -> DataFrame:
    """Per model: cover, finite, range, reproduced score and mean drift between the sides."""
    p = F.col("pred")
    n_train = train.agg(F.count("*")).scalar()
    oof = F.col("split") == "train"
    facts = store.groupBy("model").agg(
        F.sum(oof.cast("long")).alias("n_oof"),
        F.sum((p.isNull() | F.isnan(p)).cast("long")).alias("n_bad"), F.sum(((p < 0) | (p > 100)).cast("long")).alias("n_out"),
        (F.avg(F.when(~oof, p)) - F.avg(F.when(oof, p))).alias("drift")).select("*", n_train.alias("n_train"))
    led = ledger.select("model", F.col("cv_mean").alias("recorded"))
    return facts.join(recomputed.select("model", "cv_mean"), "model").join(led, "model", "left").select(
        "model", (F.col("n_oof") == F.col("n_train")).alias("covered"), (F.col("n_bad") == 0).alias("finite"), (F.col("n_out") == 0).alias("in_range"),
        F.coalesce(F.abs(F.col("cv_mean") - F.col("recorded")) <= tol, F.lit(False)).alias("reproduced"),
        (F.abs("drift") > drift_limit).alias("drift_warning"))


def content_hash(df: DataFrame, key: str = "row_id", value: str = "pred", digits: int = 9) -> DataFrame:
    """Order-free fingerprint of a keyed prediction set: sum (exact, as a decimal) and xor of full row hashes."""
    h = F.xxhash64(key, F.round(value, digits))
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("fingerprint"), F.bit_xor(h).alias("mask"))


def gap_row(ledger: DataFrame, public: Column) -> DataFrame:
    return ledger.select("model", "cv_mean", "cv_std", public.alias("public")).select(
        "*", (F.col("public") - F.col("cv_mean")).alias("gap"), gap_status(F.col("public"), F.col("cv_mean"), F.col("cv_std")).alias("status"))


def impute_contract(filled: DataFrame, medians: DataFrame, raw: DataFrame, folds: DataFrame, median_cols: Sequence[str], zero_cols: Sequence[str], key: str = "row_id") -> DataFrame:
    """Violation counts: NULLs left, structural zeros not zero, wrong median, wrong flag."""
    wide = medians.groupBy("repeat", "fold").pivot("column", list(median_cols)).agg(F.first("median"))
    joined = filled.join(F.broadcast(wide.select("repeat", "fold", *[F.col(c).alias(f"_m_{c}") for c in median_cols])), ["repeat", "fold"]).join(
        raw.select(key, *[F.col(c).alias(f"_r_{c}") for c in (*median_cols, *zero_cols)]), key)
    cols = [*median_cols, *zero_cols]
    null_left = sum((F.col(c).isNull().cast("long") for c in cols[1:]), F.col(cols[0]).isNull().cast("long"))
    zero_bad = [F.col(f"_r_{c}").isNull() & (F.col(c) != 0) for c in zero_cols]
    med_bad = [F.col(f"_r_{c}").isNull() & (F.col(c) != F.col(f"_m_{c}")) for c in median_cols]
    flag_bad = [F.col(f"_r_{c}").isNull().cast("int") != F.col(f"{c}_missing") for c in cols]
    total = lambda xs: F.sum(sum((x.cast("long") for x in xs[1:]), xs[0].cast("long")))
    return joined.agg(F.sum(null_left).alias("n_null"), total(zero_bad).alias("n_zero_bad"), total(med_bad).alias("n_median_bad"), total(flag_bad).alias("n_flag_bad"))
