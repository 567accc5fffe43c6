"""Flagship report, split, join and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import hash_sql
from ..functions.rowwise import clip, squared_error
from ..operators import encoders as en
from ..operators import folds as fo
from ..operators import metrics as mt
from ..session import lookup
from ..sources import frame as fr
from .registry import query
from .sqlbase import fold_sql, with_blocks

CELL = fo.CELL


def train_and_folds(spark, folder, target=fr.TARGET):
    frame = fr.score_frame(spark, folder)
    train = fr.train_rows(frame)
    return frame, train, fo.stratified_folds(train, target)


SMOOTHED_OOF = """
SELECT row_id, least(greatest(avg(enc), 0.0), 100.0) AS pred FROM (
  SELECT v.row_id, v.repeat,
    (coalesce(l.s, 0.0) + 20.0 * (g.s / g.n)) / (coalesce(l.n, 0) + 20.0) AS enc
  FROM (SELECT t.*, repeat, fold FROM train t JOIN folds USING (row_id)) v
  JOIN cell_all g ON g.repeat = v.repeat AND g.fold = v.fold
  LEFT JOIN cell_level l ON l.repeat = v.repeat AND l.fold = v.fold AND l.cohort_year = v.cohort_year AND l.segment = v.segment)
GROUP BY row_id"""
CELL_BLOCKS = {
    "cells": "SELECT DISTINCT repeat, fold FROM folds",
    "fitrows": "SELECT c.repeat, c.fold, t.* FROM cells c JOIN folds f ON f.repeat = c.repeat AND f.fold <> c.fold JOIN train t USING (row_id)",
    "cell_all": "SELECT repeat, fold, count(*) AS n, sum(score) AS s FROM fitrows GROUP BY ALL",
    "cell_level": "SELECT repeat, fold, cohort_year, segment, count(*) AS n, sum(score) AS s FROM fitrows GROUP BY ALL",
}


def smoothed_mean_oof(train, folds, target=fr.TARGET):
    """Out-of-fold prediction of the year-and-segment mean, shrunk to the training mean."""
    table = en.mean_encoding(train, folds, ["cohort_year", "segment"], target, 20.0)
    held = en.apply_encoding(train.select("row_id", "cohort_year", "segment"), folds, table, ["cohort_year", "segment"], "enc")
    return held.groupBy("row_id").agg(clip(F.avg("enc")).alias("pred"))


@query("flagship_oof_report", with_blocks(
    "SELECT repeat, fold, count(*) AS n, round(avg((score - pred) * (score - pred)), 6) AS mse, "
    "round(sum(w * (score - pred) * (score - pred)) / sum(w), 6) AS rw_mse "
    "FROM train JOIN oof USING (row_id) JOIN weights USING (row_id) JOIN folds USING (row_id) GROUP BY ALL",
    "folds", "weights", extra={**CELL_BLOCKS, "oof": SMOOTHED_OOF}))
def flagship(spark, folder):
    frame, train, folds = train_and_folds(spark, folder)
    oof = smoothed_mean_oof(train, folds)
    scored = mt.importance_weights(train.select("row_id", "cohort_year", fr.TARGET), fr.test_rows(frame), "cohort_year").join(oof, "row_id")
    e = squared_error(fr.TARGET, "pred")
    return fo.with_cells(scored, folds).groupBy(*CELL).agg(
        F.count("*").alias("n"), F.round(F.avg(e), 6).alias("mse"),
        F.round(F.sum(F.col("w") * e) / F.sum("w"), 6).alias("rw_mse"))


@query("sp01_strat_bins", with_blocks(
    "SELECT bin, count(*) AS n, min(score) AS lo, max(score) AS hi FROM strata GROUP BY bin", "strata"))
def strat_bins(spark, folder):
    train = fr.train_rows(fr.score_frame(spark, folder))
    return fo.strat_bins(train, fr.TARGET).groupBy("bin").agg(
        F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))


@query("sp02_stratified_folds", with_blocks("SELECT row_id, repeat, fold FROM folds", "folds"))
def stratified_folds(spark, folder):
    return train_and_folds(spark, folder)[2]


@query("sp03_fold_validation", with_blocks(
    "SELECT repeat, fold, count(*) AS n, round(avg(CASE WHEN score >= 100 THEN 1.0 ELSE 0.0 END), 6) AS pct_cap, "
    "round(avg(CASE WHEN score <= 50 THEN 1.0 ELSE 0.0 END), 6) AS pct_low, "
    "abs(avg(CASE WHEN score >= 100 THEN 1.0 ELSE 0.0 END) - (SELECT avg(CASE WHEN score >= 100 THEN 1.0 ELSE 0.0 END) FROM train)) <= 0.01 "
    "AND abs(avg(CASE WHEN score <= 50 THEN 1.0 ELSE 0.0 END) - (SELECT avg(CASE WHEN score <= 50 THEN 1.0 ELSE 0.0 END) FROM train)) <= 0.01 AS balanced "
    "FROM folds JOIN train USING (row_id) GROUP BY repeat, fold", "folds"))
def fold_validation(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    return fo.validate_folds(train, folds, fr.TARGET).select(
        *CELL, "n", F.round("pct_cap", 6).alias("pct_cap"), F.round("pct_low", 6).alias("pct_low"), "balanced")


@query("sp03b_fold_cover", with_blocks(
    "SELECT count(*) AS n_violations FROM (SELECT row_id FROM train LEFT JOIN folds USING (row_id) "
    "GROUP BY row_id HAVING count(repeat) <> 3 OR count(DISTINCT repeat) <> 3)", "folds"))
def fold_cover(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    return fo.cover_violations(train, folds).agg(F.count("*").alias("n_violations"))


@query("sp04_fold_lookup", with_blocks(
    "SELECT t.row_id, f.fold FROM train t LEFT JOIN folds f ON f.row_id = t.row_id AND f.repeat = 1", "folds"))
def fold_lookup(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    return fo.fold_lookup(train.select("row_id"), folds, 1)


@query("sp05_inner_split", with_blocks(
    "SELECT f.repeat, f.fold, CASE f.repeat " + " ".join(
        f"WHEN {r} THEN CAST(h{r} % 5 AS INTEGER)" for r in range(3)) +
    " END AS inner_fold, count(*) AS n FROM (SELECT c.repeat, c.fold, f.row_id FROM (SELECT DISTINCT repeat, fold FROM folds) c "
    "JOIN folds f ON f.repeat = c.repeat AND f.fold <> c.fold) f JOIN hashes USING (row_id) GROUP BY ALL",
    "folds", extra={"hashes": "SELECT row_id, " + ", ".join(
        f"{hash_sql('row_id', 42 + r)} AS h{r}" for r in range(3)) + " FROM train"}))
def inner_split(spark, folder):
    _, _, folds = train_and_folds(spark, folder)
    home = folds.withColumn("inner_fold", fo.inner_split("row_id", 42, F.col("repeat")))
    sizes = home.groupBy("repeat", "fold", "inner_fold").agg(F.count("*").alias("m"))
    return fo.expand_to_training(sizes).groupBy("repeat", "fold", "inner_fold").agg(F.sum("m").alias("n"))


@query("sp06_plain_kfold", with_blocks("SELECT row_id, repeat, fold FROM f", "train", extra={
    "one": "SELECT row_id, 0 AS bin FROM train", "f": fold_sql("one", seeds=(42,))}))
def plain_kfold(spark, folder):
    return fo.assign_folds(fr.train_rows(fr.score_frame(spark, folder)), stratum=None, seeds=(42,))


@query("sp06b_binary_kfold", with_blocks(
    "SELECT fold, count(*) AS n, CAST(sum(bin) AS BIGINT) AS n_test FROM f JOIN lab USING (row_id) GROUP BY fold", "frame", extra={
        "lab": "SELECT row_id, CASE WHEN split = 'test' THEN 1 ELSE 0 END AS bin FROM frame", "f": fold_sql("lab", seeds=(42,))}))
def binary_kfold(spark, folder):
    lab = fr.score_frame(spark, folder).select("row_id", (F.col("split") == "test").cast("int").alias("bin"))
    return fo.assign_folds(lab, seeds=(42,)).join(lab, "row_id").groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("bin").alias("n_test"))


@query("sp07_fold_report", with_blocks(
    "SELECT repeat, fold, count(*) AS n, round(avg(score), 6) AS mean_score, max(score) AS max_score "
    "FROM folds JOIN train USING (row_id) GROUP BY repeat, fold", "folds"))
def fold_report(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    return fo.with_cells(train, folds).groupBy(*CELL).agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("max_score"))


def _slices(pred_table):
    past = F.col("cohort_year") < fr.LATE_YEAR
    long = pred_table.unpivot(["row_id", "cohort_year", fr.TARGET], list(fr.MODELS), "model", "pred")
    e = squared_error(fr.TARGET, "pred")
    return long.groupBy("model").agg(
        F.avg(F.when(past, e)).alias("mse_past"), F.avg(F.when(~past, e)).alias("mse_late"))


SLICES_SQL = """SELECT model, avg(CASE WHEN cohort_year < 1999 THEN (score - pred) * (score - pred) END) AS mse_past,
  avg(CASE WHEN cohort_year >= 1999 THEN (score - pred) * (score - pred) END) AS mse_late
  FROM preds_long JOIN train USING (row_id) GROUP BY model"""


@query("sp08_recency_slices", with_blocks(
    "SELECT model, round(mse_past, 6) AS mse_past, round(mse_late, 6) AS mse_late FROM s", "preds_long", "train", extra={"s": SLICES_SQL}))
def recency_slices(spark, folder):
    s = _slices(fr.train_rows(fr.prediction_frame(fr.score_frame(spark, folder))))
    return s.select("model", F.round("mse_past", 6).alias("mse_past"), F.round("mse_late", 6).alias("mse_late"))


@query("sp09_train_test_union", with_blocks(
    "SELECT is_test, cohort_year, count(*) AS n FROM (SELECT *, 0 AS is_test FROM train UNION ALL SELECT *, 1 AS is_test FROM test) GROUP BY ALL",
    "train", "test"))
def train_test_union(spark, folder):
    frame = fr.score_frame(spark, folder)
    both = fr.train_rows(frame).withColumn("is_test", F.lit(0)).unionByName(
        fr.test_rows(frame).withColumn("is_test", F.lit(1)))
    return both.groupBy("is_test", "cohort_year").agg(F.count("*").alias("n"))


@query("jn01_one_to_one_join", with_blocks(
    "SELECT t.row_id, p.pred_a AS pred, count(*) OVER (PARTITION BY t.row_id) AS n_matches FROM test t LEFT JOIN preds p ON p.row_id = t.row_id", "test", "preds"))
def one_to_one_join(spark, folder):
    frame = fr.score_frame(spark, folder)
    preds = fr.prediction_frame(frame).select("row_id", F.col("pred_a").alias("pred"))
    per_key = preds.groupBy("row_id").agg(F.first("pred").alias("pred"), F.count("*").alias("n_matches"))
    return fr.test_rows(frame).select("row_id").join(per_key, "row_id", "left")


@query("jn02_frequency_lookup", with_blocks(
    "SELECT row_id, cohort_year, round(share, 6) AS share FROM train JOIN (SELECT cohort_year, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM train) AS share "
    "FROM train GROUP BY 1) USING (cohort_year)", "train"))
def frequency_lookup(spark, folder):
    train = fr.train_rows(fr.score_frame(spark, folder)).select("row_id", "cohort_year")
    total = train.agg(F.count("*")).scalar()
    share = train.groupBy("cohort_year").agg(F.count("*").alias("c")).select(
        "cohort_year", F.round(F.col("c") / total, 6).alias("share"))
    return train.join(lookup(share), "cohort_year")


@query("jn03_anti_join_upsert", with_blocks(
    "SELECT model, split, row_id, pred FROM preds_long WHERE model <> 'pred_b' UNION ALL "
    "SELECT 'pred_b', split, row_id, round(pred / 2, 6) FROM preds_long WHERE model = 'pred_c'", "preds_long"))
def anti_join_upsert(spark, folder):
    old = fr.predictions_long(fr.score_frame(spark, folder))
    new = old.filter("model = 'pred_c'").withColumn("model", F.lit("pred_b")).withColumn("pred", F.round(F.col("pred") / 2, 6))
    return old.join(F.broadcast(new.select("model").distinct()), "model", "left_anti").unionByName(new)


@query("jn04_set_checks", with_blocks(
    "SELECT (SELECT count(*) FROM train WHERE row_id IN (SELECT row_id FROM test)) AS n_shared, "
    "(SELECT count(*) FROM (SELECT row_id FROM frame EXCEPT SELECT o_orderkey FROM orders)) AS n_extra, "
    "(SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT row_id FROM frame)) AS n_lost, "
    "(SELECT count(*) FROM (SELECT row_id FROM frame GROUP BY 1 HAVING count(*) > 1)) AS n_twice", "train", "test"))
def set_checks(spark, folder):
    from ..sources.tables import read_table

    frame = fr.score_frame(spark, folder).select("row_id", "split")
    ids = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"))
    seen = frame.groupBy("row_id").agg(
        F.count("*").alias("n"), F.countDistinct("split").alias("sides"))
    both = seen.join(ids.distinct().withColumn("known", F.lit(1)), "row_id", "full_outer")
    return both.agg(
        F.sum((F.coalesce("sides", F.lit(0)) > 1).cast("long")).alias("n_shared"),
        F.sum(F.col("known").isNull().cast("long")).alias("n_extra"),
        F.sum(F.col("n").isNull().cast("long")).alias("n_lost"),
        F.sum((F.coalesce("n", F.lit(0)) > 1).cast("long")).alias("n_twice"))


@query("jn05_keyed_concat", with_blocks(
    "SELECT t.row_id, t.n_lines, p.pred_a, p.pred_b FROM train t JOIN preds p USING (row_id)", "train", "preds"))
def keyed_concat(spark, folder):
    frame = fr.score_frame(spark, folder)
    return fr.train_rows(frame).select("row_id", "n_lines").join(
        fr.prediction_frame(frame).select("row_id", "pred_a", "pred_b"), "row_id")


@query("st01_top_k", with_blocks(
    "SELECT row_id, score, pred_a, round(abs(score - pred_a), 4) AS miss FROM ptrain ORDER BY round(abs(score - pred_a), 4) DESC, row_id LIMIT 25", "ptrain"))
def top_k(spark, folder):
    p = fr.train_rows(fr.prediction_frame(fr.score_frame(spark, folder)))
    return p.select("row_id", "score", "pred_a", F.round(F.abs(F.col("score") - F.col("pred_a")), 4).alias("miss")).orderBy(
        F.col("miss").desc(), "row_id").limit(25)
