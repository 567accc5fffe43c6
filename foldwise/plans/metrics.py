"""Metric, test and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rowwise import clip, squared_error
from ..operators import folds as fo
from ..operators import metrics as mt
from ..sources import frame as fr
from .profiles import rounded, sides
from .registry import query
from .splits import SLICES_SQL, _slices
from .sqlbase import with_blocks

CELL = fo.CELL
M = list(fr.MODELS)
DOM = (0.0, 100.0)
E2 = "(score - pred) * (score - pred)"
LONG = {"pl": "SELECT l.model, l.row_id, l.pred, t.score, t.cohort_year, t.w FROM preds_long l JOIN scored t USING (row_id)"}


def scored(spark, folder):
    """Training predictions with importance weights, next to the fold table."""
    frame = fr.score_frame(spark, folder)
    preds = fr.prediction_frame(frame)
    train = fr.train_rows(preds)
    folds = fo.stratified_folds(train, fr.TARGET)
    return mt.importance_weights(train, fr.test_rows(preds), "cohort_year"), folds


def long_models(df, keep=("row_id", fr.TARGET, "w")):
    return df.unpivot(list(keep), M, "model", "pred")


@query("mt01_range_guard", with_blocks(
    "SELECT count(*) AS n_rows, 0::BIGINT AS n_bad, count(*) FILTER (WHERE p < 0 OR p > 100) AS n_out_of_range, round(min(least(greatest(p, 0), 100)), 6) AS min_clipped, round(max(least(greatest(p, 0), 100)), 6) AS max_clipped "
    "FROM (SELECT 1.3 * pred_a - 12 AS p FROM preds)", "preds"))
def range_guard(spark, folder):
    p = fr.prediction_frame(fr.score_frame(spark, folder)).select((1.3 * F.col("pred_a") - 12).alias("p"))
    return rounded(mt.range_report(p, "p"))


@query("mt02_cv_mse", with_blocks(
    "SELECT model, count(*) AS n_cells, round(avg(mse), 6) AS cv_mean, round(stddev_pop(mse), 6) AS cv_std FROM (SELECT model, repeat, fold, avg("
    + E2 + ") AS mse FROM pl JOIN folds USING (row_id) GROUP BY ALL) GROUP BY model", "folds", "preds_long", "scored", extra=LONG))
def cv_mse(spark, folder):
    df, folds = scored(spark, folder)
    return rounded(mt.cv_summary(mt.cell_mse(long_models(df), folds, fr.TARGET, "pred", groups=["model"]), ["model"]))


@query("mt03_importance_weights", with_blocks("SELECT row_id, round(w, 6) AS w FROM weights", "weights"))
def importance_weights(spark, folder):
    train, test = sides(spark, folder)
    return rounded(mt.importance_weights(train.select("row_id", "cohort_year"), test, "cohort_year").select("row_id", "w"))


@query("mt04_weighted_mse", with_blocks(f"SELECT model, round(sum(w * {E2}) / sum(w), 6) AS rw_mse FROM pl GROUP BY model", "preds_long", "scored", extra=LONG))
def weighted_mse(spark, folder):
    df, _ = scored(spark, folder)
    return rounded(mt.weighted_mse(long_models(df), fr.TARGET, "pred", "w", ["model"]))


CV_SQL = "SELECT model, avg(mse) AS cv_mean, stddev_pop(mse) AS cv_std FROM (SELECT model, repeat, fold, avg(" + E2 + ") AS mse FROM pl JOIN folds USING (row_id) GROUP BY ALL) GROUP BY model"
RW_SQL = f"SELECT model, sum(w * {E2}) / sum(w) AS rw FROM pl GROUP BY model"


def ledger(spark, folder):
    df, folds = scored(spark, folder)
    long = long_models(df)
    cv = mt.cv_summary(mt.cell_mse(long, folds, fr.TARGET, "pred", groups=["model"]), ["model"])
    return cv.join(mt.weighted_mse(long, fr.TARGET, "pred", "w", ["model"]), "model")


@query("mt05_acceptance_gate", with_blocks(
    "SELECT c.model, round(c.cv_mean, 6) AS cv_mean, c.cv_mean < b.cv_mean - 0.25 * b.cv_std AS accepted FROM c, (SELECT * FROM c WHERE model = 'pred_c') b", "folds", "preds_long", "scored", extra={**LONG, "c": CV_SQL}))
def acceptance(spark, folder):
    led = ledger(spark, folder)
    base = led.filter("model = 'pred_c'").agg(F.struct(F.first("cv_mean").alias("m"), F.first("cv_std").alias("s"))).scalar()
    return led.select("model", F.round("cv_mean", 6).alias("cv_mean"), mt.acceptance_gate(F.col("cv_mean"), base["m"], base["s"]).alias("accepted"))


@query("mt06_gap_status", with_blocks(
    "SELECT c.model, CASE WHEN abs(rw - cv_mean) <= 1.5 * cv_std THEN 'green' WHEN abs(rw - cv_mean) <= 3 * cv_std THEN 'yellow' ELSE 'red' END AS status FROM c JOIN r USING (model)",
    "folds", "preds_long", "scored", extra={**LONG, "c": CV_SQL, "r": RW_SQL}))
def gap(spark, folder):
    return ledger(spark, folder).select("model", mt.gap_status(F.col("rw_mse"), F.col("cv_mean"), F.col("cv_std")).alias("status"))


def _auc_sql(score, label, source, group=None):
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return (f"SELECT {g}round((sum(CASE WHEN lab = 1 THEN r ELSE 0 END) - sum(lab) * (sum(lab) + 1) / 2.0) / (sum(lab) * CAST(sum(1 - lab) AS DOUBLE)), 6) AS auc FROM ("
            f"SELECT {g}{label} AS lab, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {g}{score}) - 1) / 2.0 AS r FROM {source})" + (f" GROUP BY {group}" if group else ""))


@query("mt07_roc_auc", with_blocks(_auc_sql("pred", "CASE WHEN score >= 100 THEN 1 ELSE 0 END", "pl", "model"), "preds_long", "scored", extra=LONG))
def roc_auc(spark, folder):
    df, _ = scored(spark, folder)
    return rounded(mt.roc_auc(long_models(df), F.col(fr.TARGET) >= 100, "pred", ["model"], DOM))


@query("mt07b_label_auc", _auc_sql("n_chars", "quality", "(SELECT n_chars, quality FROM labels JOIN documents USING (doc_id))"))
def label_auc(spark, folder):
    from ..sources.tables import read_table

    lab = read_table(spark, folder, "labels").join(read_table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(mt.roc_auc(lab, "quality", "n_chars"))


@query("mt08_model_correlation", with_blocks(
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr, corr({a}, {b}) > 0.97 AS redundant FROM ptrain" for i, a in enumerate(M) for b in M[i + 1:]), "ptrain"))
def model_correlation(spark, folder):
    from ..operators.profile import correlation_matrix

    p = fr.train_rows(fr.prediction_frame(fr.score_frame(spark, folder)))
    c = correlation_matrix(p, M).filter(F.col("a") != F.col("b"))
    return c.select("a", "b", F.round("corr", 6).alias("corr"), (F.col("corr") > mt.REDUNDANT_CORR).alias("redundant"))


@query("mt09_spearman", with_blocks(
    "SELECT round(corr(ra, rb), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ra, rank() OVER (ORDER BY pred_a) + (count(*) OVER (PARTITION BY pred_a) - 1) / 2.0 AS rb FROM ptrain)", "ptrain"))
def spearman(spark, folder):
    p = fr.train_rows(fr.prediction_frame(fr.score_frame(spark, folder)))
    return rounded(mt.spearman(p, fr.TARGET, "pred_a", DOM, DOM))


@query("mt10_model_ranking", with_blocks(
    "SELECT model, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, round(rw, 6) AS rw_mse, CAST(row_number() OVER (ORDER BY rw, model) AS INTEGER) AS place FROM c JOIN r USING (model)",
    "folds", "preds_long", "scored", extra={**LONG, "c": CV_SQL, "r": RW_SQL}))
def model_ranking(spark, folder):
    from pyspark.sql import Window

    led = rounded(ledger(spark, folder)).drop("n_cells")
    return led.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rw_mse", "model")))


@query("mt11_weighted_cells", with_blocks(
    "SELECT repeat, fold, count(*) AS n, round(sum(w * (score - pred_a) * (score - pred_a)) / sum(w), 6) AS mse FROM scored JOIN folds USING (row_id) GROUP BY ALL", "scored", "folds"))
def weighted_cells(spark, folder):
    df, folds = scored(spark, folder)
    return rounded(mt.cell_mse(df, folds, fr.TARGET, "pred_a", weight="w"))


def _paired(spark, folder):
    df, folds = scored(spark, folder)
    both = df.withColumn("mix", (F.col("pred_a") + F.col("pred_b")) / 2)
    base = mt.cell_mse(both, folds, fr.TARGET, "pred_a", weight="w")
    new = mt.cell_mse(both, folds, fr.TARGET, "mix", weight="w")
    return both, folds, mt.paired_cells(base, new)


@query("mt12_paired_cells", with_blocks(
    "SELECT count(*) AS n_cells, count(*) FILTER (WHERE d < 0) AS improved, round(avg(d), 6) AS d_mean, round(stddev_samp(d), 6) AS d_std, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t_stat FROM ("
    "SELECT sum(w * (score - (pred_a + pred_b) / 2) * (score - (pred_a + pred_b) / 2)) / sum(w) - sum(w * (score - pred_a) * (score - pred_a)) / sum(w) AS d FROM scored JOIN folds USING (row_id) GROUP BY repeat, fold)", "scored", "folds"))
def paired_cells(spark, folder):
    p = _paired(spark, folder)[2]
    return p.select("n_cells", "improved", F.round("d_mean", 6).alias("d_mean"), F.round("d_std", 6).alias("d_std"), F.round("t_stat", 4).alias("t_stat"))


def _errors(both):
    return squared_error(fr.TARGET, clip("pred_a")), squared_error(fr.TARGET, clip("mix"))


@query("mt13_row_bootstrap")
def row_bootstrap(spark, folder):
    both, _, _ = _paired(spark, folder)
    e0, e1 = _errors(both)
    return mt.bootstrap_interval(mt.bootstrap_deltas(both, "row_id", F.col("w"), e0, e1))


@query("mt14_blocked_bootstrap")
def blocked_bootstrap(spark, folder):
    both, folds, _ = _paired(spark, folder)
    sums = mt.cell_error_sums(both, folds, "w", *_errors(both))
    cells = mt.bootstrap_interval(mt.blocked_bootstrap(sums)).withColumn("scheme", F.lit("cells"))
    within = mt.bootstrap_interval(mt.blocked_bootstrap(sums, within_repeat=True)).withColumn("scheme", F.lit("folds_in_repeat"))
    return cells.unionByName(within)


@query("mt15_gate_verdict")
def gate_verdict(spark, folder):
    both, _, paired = _paired(spark, folder)
    e0, e1 = _errors(both)
    return mt.gate_verdict(mt.with_p_value(paired), mt.bootstrap_interval(mt.bootstrap_deltas(both, "row_id", F.col("w"), e0, e1)))


@query("mt17_gain_concentration", with_blocks(
    "SELECT count(*) AS n_rows, round(sum(g), 6) AS net_gain, count(*) FILTER (WHERE g > 0) AS n_helped, count(*) FILTER (WHERE g < 0) AS n_hurt, "
    "round((SELECT sum(g) FROM (SELECT g FROM g ORDER BY g DESC, row_id LIMIT 100)), 6) AS top_gain, round((SELECT sum(g) FROM (SELECT g FROM g ORDER BY g DESC, row_id LIMIT 100)) / sum(g), 6) AS top_share FROM g",
    "ptrain", extra={"g": "SELECT row_id, (score - pred_b) * (score - pred_b) - (score - pred_a) * (score - pred_a) AS g FROM ptrain"}))
def gain_concentration(spark, folder):
    p = fr.train_rows(fr.prediction_frame(fr.score_frame(spark, folder)))
    return rounded(mt.gain_concentration(p, fr.TARGET, "pred_b", "pred_a", 100))


COVARIATES = ["cohort_year", "acctbal", "n_lines", "avg_qty", "ext_price", "disc_pts"]


@query("mt18_density_ratio")
def density_ratio(spark, folder):
    train, test = sides(spark, folder)
    info, _ = mt.density_ratio(train, test, COVARIATES)
    rows = [(r["alpha"], r["sigma"], r["lam"], r["pe"], r["ess"], r["ess_frac"]) for r in info]
    return spark.createDataFrame(rows, "alpha double, sigma double, lam double, pe double, ess double, ess_frac double")


@query("mt19_reweighted_ranking")
def reweighted_ranking(spark, folder):
    from pyspark.sql import Window

    train, test = sides(spark, folder)
    info, weighted = mt.density_ratio(train, test, COVARIATES)
    chosen = mt.choose_alpha(info)
    preds, _ = scored(spark, folder)
    both = preds.join(weighted(chosen).select("row_id", F.col("w").alias("w_ratio")), "row_id")
    long = both.unpivot(["row_id", fr.TARGET, "w", "w_ratio"], M, "model", "pred")
    table = mt.weighted_mse(long, fr.TARGET, "pred", "w", ["model"]).join(
        mt.weighted_mse(long, fr.TARGET, "pred", "w_ratio", ["model"]).withColumnRenamed("rw_mse", "iw_mse"), "model")
    return table.select("model", "rw_mse", "iw_mse", F.lit(chosen).alias("alpha"),
                        F.rank().over(Window.partitionBy(F.lit(0)).orderBy("rw_mse")).alias("rank_primary"),
                        F.rank().over(Window.partitionBy(F.lit(0)).orderBy("iw_mse")).alias("rank_reweighted"))


@query("mt20_variance_ratio", with_blocks(
    "SELECT round((sum(w * score * score) / sum(w) - pow(sum(w * score) / sum(w), 2)) / var_pop(score), 6) AS var_ratio FROM scored", "scored"))
def variance_ratio(spark, folder):
    df, _ = scored(spark, folder)
    return rounded(mt.variance_ratio(df, fr.TARGET, "w"))


@query("mt21_forward_ranking", with_blocks(
    "SELECT round(corr(ra, rb), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY mse_past) AS ra, rank() OVER (ORDER BY mse_late) AS rb FROM s)", "preds_long", "train", extra={"s": SLICES_SQL}))
def forward_ranking(spark, folder):
    s = _slices(fr.train_rows(fr.prediction_frame(fr.score_frame(spark, folder))))
    return rounded(mt.spearman(s, "mse_past", "mse_late"))
