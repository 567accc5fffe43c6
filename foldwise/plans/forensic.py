"""Forensic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rowwise import row_std
from ..operators import forensics as fx
from ..session import pin
from ..sources import frame as fr
from .metrics import scored
from .profiles import rounded, sides
from .registry import query
from .sqlbase import bin_edges, bin_number, with_blocks

BL = {"b": "SELECT *, round((pred_a + pred_b) / 2, 6) AS blend FROM scored"}
Y, P = fr.TARGET, "blend"


def blended(spark, folder):
    df, folds = scored(spark, folder)
    return df.withColumn(P, F.round((F.col("pred_a") + F.col("pred_b")) / 2, 6)), folds


def q(body, **extra):
    return with_blocks(body, "scored", extra={**BL, **extra})


def cnt(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


@query("fx01_target_fingerprint", with_blocks(
    "SELECT count(*) AS n, " + ", ".join([
        cnt("abs(score - 100) < 1e-6", "n_cap"), cnt("abs(score) < 1e-6", "n_floor"), cnt("abs(score - round(score)) < 1e-6", "n_integer"),
        cnt("abs(score * 10 - round(score * 10)) < 1e-6", "n_grid_01"), cnt("abs(score * 100 - round(score * 100)) < 1e-6", "n_grid_001"),
        cnt("score >= 98 AND score < 99", "n_98_99"), cnt("score >= 99 AND score < 99.99", "n_99_9999"), cnt("score >= 99.99 AND score < 100", "n_9999_100"),
        cnt("score >= 95 AND score < 100", "n_95_100"), cnt("score >= 99.5 AND score < 100", "n_995_100")]) + " FROM train", "train"))
def fingerprint(spark, folder):
    return fx.target_fingerprint(sides(spark, folder)[0], Y)


@query("fx02_residual_moments", q(
    "SELECT CAST(n AS DOUBLE) AS n, round(mu, 6) AS mean, round(sqrt(m2), 6) AS std, round(m2, 6) AS var, round(c, 6) AS mean_at_cap, round(i, 6) AS mean_interior, "
    "round(sqrt(n * (n - 1.0)) / (n - 2) * m3 / pow(m2, 1.5), 6) AS skew, round((n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6), 6) AS kurtosis FROM ("
    "SELECT count(*)::DOUBLE AS n, any_value(mu) AS mu, avg(pow(r - mu, 2)) AS m2, avg(pow(r - mu, 3)) AS m3, avg(pow(r - mu, 4)) AS m4, avg(CASE WHEN score >= 100 THEN r END) AS c, avg(CASE WHEN score > 0.5 AND score < 99.5 THEN r END) AS i "
    "FROM (SELECT score, score - blend AS r FROM b), (SELECT avg(score - blend) AS mu FROM b))"))
def residual_moments(spark, folder):
    return rounded(fx.residual_moments(blended(spark, folder)[0], Y, P))


def _bins(n):
    return {"e": bin_edges("b", "blend", n), "pb": f"SELECT {bin_number('blend')} AS bin, count(*) AS n, avg(blend) AS pm, avg(score - blend) AS rm, stddev_samp(score - blend) AS rs, stddev_samp(abs(score - blend)) AS ars, "
            "avg(CASE WHEN abs(score - blend) < 0.5 THEN 1.0 ELSE 0.0 END) AS nz, avg(CASE WHEN score >= 100 THEN 1.0 ELSE 0.0 END) AS cr FROM b, e GROUP BY 1"}


@query("fx03_spread_by_decile", q("SELECT bin, n, round(pm, 6) AS pred_mean, round(rs, 6) AS res_std FROM pb", **_bins(10)))
def spread_by_decile(spark, folder):
    return rounded(fx.by_prediction_bin(blended(spark, folder)[0], Y, P, 10).select("bin", "n", "pred_mean", "res_std"))


@query("fx04_spread_law", q(
    "SELECT round(regr_slope(rs, pm), 6) AS slope, round(regr_intercept(rs, pm), 6) AS intercept, round(regr_slope(ars, pm), 6) AS slope_abs, round(regr_intercept(ars, pm), 6) AS intercept_abs FROM pb", **_bins(8)))
def spread_law(spark, folder):
    return rounded(fx.spread_law(blended(spark, folder)[0], Y, P))


@query("fx05_bias_by_bin", q("SELECT bin, n, round(pm, 6) AS pred_mean, round(rm, 6) AS res_mean, round(rs, 6) AS res_std FROM pb", **_bins(12)))
def bias_by_bin(spark, folder):
    return rounded(fx.by_prediction_bin(blended(spark, folder)[0], Y, P, 12).select("bin", "n", "pred_mean", "res_mean", "res_std"))


PARTS = ("SELECT round(avg(e), 6) AS mse, round(avg(CASE WHEN score > 0.5 AND score < 99.5 THEN e END), 6) AS mse_interior, round(avg(CASE WHEN score >= 100 THEN e END), 6) AS mse_at_cap, "
         + cnt("score > 0.5 AND score < 99.5", "n_interior") + ", " + cnt("score >= 100", "n_at_cap") + ", round(sum(CASE WHEN score >= 100 THEN e ELSE 0 END) / count(*), 6) AS cap_contribution, "
         "round(avg(CASE WHEN score >= 100 THEN (score - 100) * (score - 100) ELSE e END), 6) AS mse_oracle FROM (SELECT score, (score - blend) * (score - blend) AS e FROM b)")


@query("fx06_mse_parts", q("SELECT * EXCLUDE (mse_oracle) FROM (" + PARTS + ")"))
def mse_parts(spark, folder):
    return rounded(fx.mse_parts(blended(spark, folder)[0], Y, P)).drop("mse_oracle")


@query("fx07_oracle_ceiling", q("SELECT mse, mse_oracle FROM (" + PARTS + ")"))
def oracle_ceiling(spark, folder):
    return rounded(fx.mse_parts(blended(spark, folder)[0], Y, P)).select("mse", "mse_oracle")


THR = [80.0, 84.0, 86.0, 88.0, 90.0, 92.0]


@query("fx08_push_sweep", q(
    "SELECT threshold, count(*) FILTER (WHERE blend >= threshold) AS n_pushed, round(avg(CASE WHEN blend >= threshold THEN CASE WHEN score >= 100 THEN 1.0 ELSE 0.0 END END), 6) AS \"precision\", "
    "round(avg(CASE WHEN blend >= threshold THEN (score - 100) * (score - 100) ELSE (score - blend) * (score - blend) END) - avg((score - blend) * (score - blend)), 6) AS mse_delta FROM b, "
    "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in THR) + "]) AS threshold) GROUP BY threshold"))
def push_sweep(spark, folder):
    return rounded(fx.push_sweep(blended(spark, folder)[0], Y, P, THR))


@query("fx09_near_zero", q(
    "SELECT " + cnt("abs(r) < 0.5", "n_near") + ", round(avg(CASE WHEN abs(r) < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share, " + cnt("abs(r) < 0.1", "n_01") +
    ", round(1.0 / (stddev_pop(r) * sqrt(2 * pi())), 6) AS expected_share, " + cnt("abs(r) < 0.5 AND score >= 100", "n_near_cap") + ", " + cnt("abs(r) < 0.5 AND score > 0.5 AND score < 99.5", "n_near_interior") +
    " FROM (SELECT score, score - blend AS r FROM b)"))
def near_zero(spark, folder):
    return rounded(fx.near_zero(blended(spark, folder)[0], Y, P))


@query("fx09b_near_zero_by_bin", q("SELECT bin, n, round(nz, 6) AS near0_rate, round(cr, 6) AS cap_rate FROM pb", **_bins(10)))
def near_zero_by_bin(spark, folder):
    return rounded(fx.by_prediction_bin(blended(spark, folder)[0], Y, P, 10).select("bin", "n", "near0_rate", "cap_rate"))


@query("fx10_model_disagreement", q(
    "SELECT round(d, 6) AS disagree_std, round(r, 6) AS resid_std, round(1 - (d / r) * (d / r), 6) AS irreducible FROM (SELECT stddev_pop(pred_a - pred_b) AS d, stddev_pop(score - 0.5 * (pred_a + pred_b)) AS r FROM b)"))
def model_disagreement(spark, folder):
    return rounded(fx.model_disagreement(blended(spark, folder)[0], Y, "pred_a", "pred_b"))


def _affine(w):
    return q(f"SELECT round(a, 6) AS a, round(c, 6) AS b, round(sum(w * pow(score - blend, 2)) / sum(w), 6) AS rw_before, round(sum(w * pow(score - least(greatest(a * blend + c, 0), 100), 2)) / sum(w), 6) AS rw_after "
             f"FROM b, (SELECT a, (sy - a * sp) / s AS c FROM (SELECT *, (spy - sp * sy / s) / (spp - sp * sp / s) AS a FROM (SELECT sum({w}) AS s, sum({w} * blend) AS sp, sum({w} * score) AS sy, sum({w} * blend * blend) AS spp, sum({w} * blend * score) AS spy FROM b))) GROUP BY a, c")


@query("fx11_affine_fit", _affine("w"))
def affine_fit(spark, folder):
    return rounded(fx.affine_fit(blended(spark, folder)[0], Y, P, "w"))


@query("fx11b_affine_fit_literal", _affine("w * w"))
def affine_fit_literal(spark, folder):
    return rounded(fx.affine_fit(blended(spark, folder)[0], Y, P, "w", literal=True))


@query("fx14_error_budget", q(
    "SELECT CAST((score > 20)::INT + (score > 40)::INT + (score > 60)::INT + (score > 80)::INT + (score > 99)::INT AS INTEGER) AS band, count(*) AS n, round(avg(CASE WHEN abs(score - blend) >= 10 THEN 1.0 ELSE 0.0 END), 6) AS bad_share, "
    "round(avg(score - blend), 6) AS res_mean, round(sum((score - blend) * (score - blend)), 4) AS sse FROM b GROUP BY 1"))
def error_budget(spark, folder):
    b = fx.error_budget(blended(spark, folder)[0], Y, P, [20.0, 40.0, 60.0, 80.0, 99.0], 10.0)
    return b.select("band", "n", F.round("bad_share", 6).alias("bad_share"), F.round("res_mean", 6).alias("res_mean"), F.round("sse", 4).alias("sse"))


RULES_SQL = {"building": "segment = 'BUILDING'", "finished": "status = 'F'", "late": "cohort_year >= 1999", "high_text": "pred_e > 80"}


def rules():
    return {"building": F.col("segment") == "BUILDING", "finished": F.col("status") == "F", "late": F.col("cohort_year") >= 1999, "high_text": F.col("pred_e") > 80}


@query("fx15_hypothesis_probe", q(" UNION ALL ".join(
    f"SELECT '{n}' AS pattern, round(corr(({c})::INT, score), 6) AS corr_y, round(corr(({c})::INT, blend), 6) AS corr_pred, round(corr(({c})::INT, score - blend), 6) AS corr_resid FROM b" for n, c in RULES_SQL.items())))
def hypothesis_probe(spark, folder):
    return rounded(fx.hypothesis_probe(blended(spark, folder)[0], rules(), Y, P))


@query("fx16_rule_triggers", q(" UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS n_fired, round(avg(CASE WHEN {c} THEN score - blend END), 6) AS res_fired, round(avg(score - blend), 6) AS res_all, count(*) FILTER (WHERE {c}) < 30 AS small_n FROM b" for n, c in RULES_SQL.items())))
def rule_triggers(spark, folder):
    return rounded(fx.rule_triggers(blended(spark, folder)[0], rules(), Y, P))


@query("fx17_calibration_by_feature", with_blocks(
    f"SELECT {bin_number('acctbal')} AS bin, count(*) AS n, round(avg(score - blend), 6) AS res_mean FROM f, e GROUP BY 1", "scored", "train", extra={
        **BL, "f": "SELECT b.*, t.acctbal FROM b JOIN train t USING (row_id)", "e": bin_edges("f", "acctbal", 5)}))
def calibration_by_feature(spark, folder):
    df, _ = blended(spark, folder)
    feats = sides(spark, folder)[0].select("row_id", "acctbal")
    return rounded(fx.calibration_by_feature(df.join(feats, "row_id"), "acctbal", Y, P))


@query("fx21_confidence", q(
    f"SELECT {bin_number('conf')} AS decile, count(*) AS n, round(avg((score - blend) * (score - blend)), 6) AS mse FROM c, e GROUP BY 1", **{
        "c": "SELECT *, round(0.6::DOUBLE * (1 - percent_rank() OVER (ORDER BY sd)) + 0.4::DOUBLE * percent_rank() OVER (ORDER BY blend), 6) AS conf FROM (SELECT *, round(list_stddev_samp([pred_a, pred_b, pred_c, pred_e]), 6) AS sd FROM b)",
        "e": bin_edges("c", "conf", 10)}))
def confidence(spark, folder):
    df, _ = blended(spark, folder)
    df = df.select("row_id", Y, P, *fr.MODELS).withColumn("sd", F.round(row_std(["pred_a", "pred_b", "pred_c", "pred_e"]), 6))
    conf = pin(fx.confidence(df.select("row_id", Y, P, "sd"), "sd", P).withColumn("confidence", F.round("confidence", 6)))
    return rounded(fx.mse_by_decile(conf, "confidence", Y, P))
