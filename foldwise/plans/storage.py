"""Source, sink, ledger, audit and publishing queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import encoders as en
from ..operators import features as fe
from ..operators import folds as fo
from ..operators import metrics as mt
from ..operators import publish as pb
from ..session import fresh_path, pin
from ..sources import frame as fr
from ..sources import store as st
from ..sources.tables import BOM, read_wide_csv
from .metrics import CV_SQL, LONG, RW_SQL, ledger, long_models, scored
from .profiles import rounded, sides
from .registry import query
from .splits import train_and_folds
from .sqlbase import with_blocks

M = list(fr.MODELS)


@query("io01_wide_csv_roundtrip", with_blocks(
    "SELECT split, count(*) AS n, count(ret_qty) AS n_ret_qty, round(sum(score), 2) AS sum_score, round(sum(ext_price), 2) AS sum_price FROM frame GROUP BY split", "frame"))
def wide_csv(spark, folder):
    frame = fr.score_frame(spark, folder)
    path = fresh_path(spark, "wide")
    frame.toDF(BOM + frame.columns[0], *frame.columns[1:]).write.option("header", True).csv(path)
    back = read_wide_csv(spark, path, frame.schema)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.count("ret_qty").alias("n_ret_qty"), F.round(F.sum("score"), 2).alias("sum_score"), F.round(F.sum("ext_price"), 2).alias("sum_price"))


@query("io02_strip_bom", with_blocks("SELECT count(row_id) AS n, CAST(sum(row_id) AS BIGINT) AS s FROM frame", "frame"))
def strip_bom_query(spark, folder):
    from ..sources.tables import strip_bom

    frame = fr.score_frame(spark, folder).select(F.col("row_id").alias(f"{BOM}row_id"))
    return strip_bom(frame).agg(F.count("row_id").alias("n"), F.sum("row_id").alias("s"))


@query("io03_fold_table_roundtrip", with_blocks("SELECT row_id, repeat, fold FROM folds", "folds"))
def fold_roundtrip(spark, folder):
    path = fresh_path(spark, "folds")
    train_and_folds(spark, folder)[2].write.parquet(path)
    return spark.read.parquet(path)


def saved_store(spark, folder):
    path = fresh_path(spark, "predictions")
    long = fr.predictions_long(fr.score_frame(spark, folder))
    st.write_predictions(long.filter(F.col("model").isin(M[:4])), path)
    # pred_e arrives later and only for the training side
    st.write_predictions(long.filter("model = 'pred_e' AND split = 'train'"), path)
    return path


@query("io04_prediction_store", with_blocks(
    "SELECT model, split, count(*) AS n, round(sum(pred), 4) AS total FROM preds_long WHERE model <> 'pred_e' OR split = 'train' GROUP BY ALL", "preds_long"))
def prediction_store(spark, folder):
    return st.read_predictions(spark, saved_store(spark, folder)).groupBy("model", "split").agg(F.count("*").alias("n"), F.round(F.sum("pred"), 4).alias("total"))


@query("io05_prediction_matrix", with_blocks("SELECT row_id, pred_a, pred_b, CAST(NULL AS DOUBLE) AS pred_e FROM ptrain", "ptrain"))
def prediction_matrix(spark, folder):
    models = ["pred_a", "pred_b", "pred_e"]
    return st.prediction_matrix(st.read_predictions(spark, saved_store(spark, folder), models), models, "train")


@query("io06_available_models", with_blocks("SELECT model FROM preds_long WHERE model <> 'pred_e' OR split = 'train' GROUP BY model HAVING count(DISTINCT split) = 2", "preds_long"))
def available_models(spark, folder):
    return st.available_models(st.read_predictions(spark, saved_store(spark, folder)))


def _ledger(spark, folder):
    return rounded(ledger(spark, folder)).drop("n_cells")


LEDGER_SQL = "SELECT model, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, round(rw, 6) AS rw_mse FROM c JOIN r USING (model)"
LB = {**LONG, "c": CV_SQL, "r": RW_SQL, "led": LEDGER_SQL}


@query("io07_ledger_upsert", with_blocks(
    "SELECT model, cv_mean, cv_std, rw_mse FROM led WHERE model <> 'pred_a' UNION ALL SELECT 'pred_a', cv_mean, cv_std, rw_mse FROM led WHERE model = 'pred_b'", "folds", "preds_long", "scored", extra=LB))
def ledger_upsert(spark, folder):
    led = pin(_ledger(spark, folder))
    return st.upsert(led, led.filter("model = 'pred_b'").withColumn("model", F.lit("pred_a")), ["model"]).orderBy("model")


@query("io08_score_ledger", with_blocks("SELECT model, cv_mean, cv_std FROM led", "folds", "preds_long", "scored", extra=LB))
def score_ledger(spark, folder):
    return _ledger(spark, folder).select("model", "cv_mean", "cv_std")


@query("io09_detail_ledger")
def detail_ledger(spark, folder):
    df, folds = scored(spark, folder)
    return st.detail_rows(mt.cell_mse(long_models(df), folds, fr.TARGET, "pred", groups=["model"]), ["model"], "mse")


@query("io10_decision_ledger", with_blocks(
    "SELECT model, cv_mean, cv_std, rw_mse, model LIKE '%_w' AS weighted_training, 'base' AS note FROM led", "folds", "preds_long", "scored", extra=LB))
def decision_ledger(spark, folder):
    return _ledger(spark, folder).withColumn("weighted_training", F.col("model").endswith("_w")).withColumn("note", F.lit("base"))


@query("io11_feature_cache", with_blocks("SELECT count(*) AS n, count(ret_qty) AS n_ret, round(sum(ext_price), 2) AS s FROM frame", "frame"))
def feature_cache(spark, folder):
    path = fresh_path(spark, "features")
    frame = fr.score_frame(spark, folder)
    fe.add_columns(frame.select("row_id", *fr.NUMERICS), fe.derived(frame), ["all_mean", "year_gap"]).write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count("ret_qty").alias("n_ret"), F.round(F.sum("ext_price"), 2).alias("s"))


@query("io12_text_features", "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS len_char FROM documents")
def text_features(spark, folder):
    from ..operators.text import handcrafted

    path = fresh_path(spark, "textfeatures")
    handcrafted(fr.text_frame(spark, folder), "text").write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum(F.col("len_char").cast("long")).alias("len_char"))


@query("io13_report_csv", with_blocks("SELECT model, cv_mean, rw_mse FROM led", "folds", "preds_long", "scored", extra=LB))
def report_csv(spark, folder):
    path = fresh_path(spark, "report")
    st.write_report(_ledger(spark, folder).select("model", "cv_mean", "rw_mse"), path)
    return spark.read.schema("model string, cv_mean double, rw_mse double").option("header", True).csv(path)


@query("io14_manifest_json")
def manifest_json(spark, folder):
    path = fresh_path(spark, "manifest")
    m = fe.column_manifest(sides(spark, folder)[0])
    st.write_manifest(m, path)
    return spark.read.schema(m.schema).json(path)


def canonical(spark, folder):
    frame = fr.score_frame(spark, folder)
    return fr.test_rows(frame).select("row_id", F.col("row_id").alias("ordinal")), fr.test_rows(fr.prediction_frame(frame))


@query("io15_submission_file", with_blocks("SELECT row_id, pred_a AS score FROM preds WHERE split = 'test'", "preds"))
def submission_file(spark, folder):
    rows, preds = canonical(spark, folder)
    sub = pb.build_submission(rows, preds.select("row_id", F.col("pred_a").alias("pred")))
    path = fresh_path(spark, "submission")
    st.write_submission(sub, path, "ordinal", ["row_id", "score"])
    return spark.read.schema(T.StructType([T.StructField("row_id", T.LongType()), T.StructField("score", T.DoubleType())])).option("header", True).csv(path)


@query("io16_log_upsert_widening", with_blocks(
    "SELECT model, cv_mean, CAST(NULL AS DOUBLE) AS public FROM led WHERE model <> 'pred_a' UNION ALL SELECT model, cv_mean, rw_mse AS public FROM led WHERE model = 'pred_a'", "folds", "preds_long", "scored", extra=LB))
def log_upsert(spark, folder):
    led = pin(_ledger(spark, folder))
    return st.upsert(led.select("model", "cv_mean"), led.filter("model = 'pred_a'").select("model", "cv_mean", F.col("rw_mse").alias("public")), ["model"])


@query("io17_embedding_columns", "SELECT label, count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64) AS n_dim FROM embeddings GROUP BY label")
def embedding_columns(spark, folder):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    emb = fr.embedding_frame(spark, folder).withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))
    return emb.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.size(vector_to_array("v")) == 64).cast("long")).alias("n_dim"))


@query("io18_external_intake", with_blocks(
    "SELECT count(*) AS n_rows, count(DISTINCT row_id) AS n_keys, 0::BIGINT AS n_not_finite, count(*) FILTER (WHERE p < -1e-9 OR p > 100 + 1e-9) AS n_out_of_range, (SELECT count(*) FROM test) AS expected, "
    "count(*) FILTER (WHERE p < -1e-9 OR p > 100 + 1e-9) = 0 AS accepted FROM (SELECT row_id, pred_a * 1.2::DOUBLE AS p FROM preds WHERE split = 'test')", "preds", "test"))
def external_intake(spark, folder):
    rows, preds = canonical(spark, folder)
    return st.intake_report(preds.select("row_id", (F.col("pred_a") * 1.2).alias("pred")), "row_id", "pred", rows.agg(F.count("*")).scalar())


ALLOWED = ["pred_a", "pred_c", "pred_d"]


@query("fn01_pick_best", with_blocks("SELECT model, cv_mean FROM led WHERE model IN ('pred_a', 'pred_c', 'pred_d') ORDER BY cv_mean, model LIMIT 1", "folds", "preds_long", "scored", extra=LB))
def pick_best(spark, folder):
    return pb.pick_best(_ledger(spark, folder), ALLOWED).select("model", "cv_mean")


@query("fn02_build_submission", with_blocks("SELECT row_id, row_id AS ordinal, round(least(greatest(1.1::DOUBLE * pred_a, 0), 100), 7) AS score, 1::BIGINT AS n_matches FROM preds WHERE split = 'test'", "preds"))
def build_submission(spark, folder):
    rows, preds = canonical(spark, folder)
    return rounded(pb.build_submission(rows, preds.select("row_id", (1.1 * F.col("pred_a")).alias("pred"))), 7)


@query("fn02b_submission_checks", with_blocks(
    "SELECT count(*) FILTER (WHERE row_id % 37 = 0) AS missing_key, count(*) FILTER (WHERE row_id % 19 = 0) AS unknown_key, "
    "count(*) FILTER (WHERE row_id % 37 <> 0 AND row_id % 13 = 0) AS duplicate_key, count(*) FILTER (WHERE row_id % 37 <> 0 AND row_id % 17 = 0) AS null_value, "
    "count(*) FILTER (WHERE row_id % 37 <> 0 AND row_id % 17 <> 0 AND row_id % 23 = 0) AS not_finite, "
    "count(*) FILTER (WHERE row_id % 37 <> 0 AND row_id % 17 <> 0 AND (row_id % 23 = 0 OR row_id % 29 = 0)) AS out_of_range, "
    "count(*) FILTER (WHERE row_id % 37 <> 0 AND row_id % 31 = 0) AS wrong_order, count(*) FILTER (WHERE row_id % 37 <> 0 AND row_id % 17 <> 0 AND row_id % 11 = 0) AS many_predictions FROM test", "test"))
def submission_checks(spark, folder):
    """The eight checks over planted faults: lost, foreign and repeated keys, gaps, NaN, range, order, several predictions."""
    rows, preds = canonical(spark, folder)
    hit = lambda n: F.col("row_id") % n == 0
    given = preds.filter(~hit(17)).select("row_id", F.when(hit(23), F.lit(float("nan"))).otherwise(F.col("pred_a")).alias("pred"))
    sub = pb.build_submission(rows, given.unionByName(given.filter(hit(11))))
    sub = sub.withColumn("score", F.when(hit(29), F.col("score") + 200.0).otherwise(F.col("score"))).withColumn("ordinal", F.when(hit(31), F.col("ordinal") + 1).otherwise(F.col("ordinal")))
    foreign = sub.filter(hit(19)).select((-1 - F.col("row_id")).alias("row_id"), F.col("ordinal"), F.lit(50.0).alias("score"), F.lit(1).cast("long").alias("n_matches"))
    kept = sub.filter(~hit(37))
    return pb.submission_violations(kept.unionByName(kept.filter(hit(13))).unionByName(foreign), rows)


@query("fn03_final_diversity", with_blocks("SELECT count(*) AS n, round(avg(abs(pred_a - pred_b)), 6) AS mean_abs_diff, round(max(abs(pred_a - pred_b)), 6) AS max_abs_diff FROM preds WHERE split = 'test'", "preds"))
def final_diversity(spark, folder):
    _, preds = canonical(spark, folder)
    return rounded(pb.mean_difference(preds.select("row_id", F.col("pred_a").alias("score")), preds.select("row_id", F.col("pred_b").alias("score"))))


FAULTY_STORE = {
    "store": "SELECT model, split, row_id, CASE WHEN model = 'pred_c' AND row_id % 29 = 0 THEN 'nan'::DOUBLE WHEN model = 'pred_d' AND row_id % 31 = 0 THEN pred + 200 ELSE pred END AS pred "
             "FROM preds_long WHERE NOT (model = 'pred_b' AND split = 'train' AND row_id % 37 = 0)"}


@query("fn04_artifact_audit", with_blocks(
    "SELECT model, count(*) FILTER (WHERE split = 'train') = (SELECT count(*) FROM train) AS covered, count(*) FILTER (WHERE isnan(pred)) = 0 AS finite, "
    "count(*) FILTER (WHERE pred < 0 OR pred > 100) = 0 AS in_range, model <> 'pred_a' AS reproduced, "
    "abs(avg(CASE WHEN split = 'test' THEN pred END) - avg(CASE WHEN split = 'train' THEN pred END)) > 5 AS drift_warning FROM store GROUP BY model", "preds_long", "train", extra=FAULTY_STORE))
def artifact_audit(spark, folder):
    """Planted faults: a model with lost rows, one with NaN, one out of range, one whose recorded score is off."""
    frame = fr.score_frame(spark, folder)
    led = pin(ledger(spark, folder))
    hit = lambda m, n: (F.col("model") == m) & (F.col("row_id") % n == 0)
    pred = F.when(hit("pred_c", 29), F.lit(float("nan"))).when(hit("pred_d", 31), F.col("pred") + 200.0).otherwise(F.col("pred"))
    faulty = fr.predictions_long(frame).filter(~(hit("pred_b", 37) & (F.col("split") == "train"))).withColumn("pred", pred)
    recorded = rounded(led).withColumn("cv_mean", F.col("cv_mean") + F.when(F.col("model") == "pred_a", 1e-3).otherwise(0.0))
    return pb.artifact_audit(faulty, fr.train_rows(frame), led, recorded)


FAULTY_FOLDS = {
    "faulty": "SELECT row_id, repeat, CASE WHEN repeat = 0 AND score >= 100 THEN 0 ELSE fold END AS fold, score FROM folds JOIN train USING (row_id) WHERE NOT (repeat = 1 AND row_id % 41 = 0) "
              "UNION ALL SELECT row_id, repeat, fold, score FROM folds JOIN train USING (row_id) WHERE repeat = 2 AND row_id % 43 = 0",
    "shares": "SELECT avg(CAST(score >= 100 AS INT)) AS c, avg(CAST(score <= 50 AS INT)) AS l FROM train",
    "cells": "SELECT repeat, fold, count(*) AS n, avg(CAST(score >= 100 AS INT)) AS c, avg(CAST(score <= 50 AS INT)) AS l FROM faulty GROUP BY ALL"}


@query("fn05_fold_audit", with_blocks(
    "SELECT (SELECT count(*) * 3 FROM train) AS expected_rows, CAST(sum(cells.n) AS BIGINT) AS n_rows, "
    "count(*) FILTER (WHERE abs(cells.c - shares.c) > 0.01 OR abs(cells.l - shares.l) > 0.01) AS n_unbalanced, "
    "(SELECT count(*) FROM train WHERE row_id % 41 = 0 OR row_id % 43 = 0) AS n_cover FROM cells, shares", "train", "folds", extra=FAULTY_FOLDS))
def fold_audit(spark, folder):
    """Planted faults: rows lost from one repeat, rows listed twice in another, all capped rows in one fold of the first."""
    _, train, folds = train_and_folds(spark, folder)
    hit = lambda n: F.col("row_id") % n == 0
    capped = train.select("row_id", (F.col(fr.TARGET) >= 100).alias("capped"))
    faulty = folds.join(capped, "row_id").withColumn("fold", F.when((F.col("repeat") == 0) & F.col("capped"), F.lit(0)).otherwise(F.col("fold"))).drop("capped")
    faulty = pin(faulty.filter(~((F.col("repeat") == 1) & hit(41))).unionByName(folds.filter((F.col("repeat") == 2) & hit(43)).select(*faulty.columns)))
    cells = fo.validate_folds(train, faulty, fr.TARGET)
    cover = fo.cover_violations(train, faulty).agg(F.count("*")).scalar()
    expected = train.agg(F.count("*") * 3).scalar()
    return cells.agg(F.sum("n").alias("n_rows"), F.sum((~F.col("balanced")).cast("long")).alias("n_unbalanced")).select(
        "*", expected.alias("expected_rows"), cover.alias("n_cover"))


@query("fn06_submission_audit", with_blocks(
    "SELECT count(*) FILTER (WHERE row_id % 37 <> 0) + count(*) FILTER (WHERE row_id % 19 = 0) AS n, 0.5::DOUBLE * max(CAST(row_id % 37 <> 0 AND row_id % 29 = 0 AS INT)) AS max_diff, "
    "count(*) FILTER (WHERE row_id % 37 = 0) AS n_missing, count(*) FILTER (WHERE row_id % 19 = 0) AS n_unknown FROM test", "test"))
def submission_audit(spark, folder):
    """A written file against its source, with planted faults: lost rows, foreign rows, changed values."""
    rows, preds = canonical(spark, folder)
    path = fresh_path(spark, "audited")
    hit = lambda n: F.col("row_id") % n == 0
    sub = pb.build_submission(rows, preds.select("row_id", F.col("pred_a").alias("pred")))
    foreign = sub.filter(hit(19)).withColumn("row_id", -1 - F.col("row_id"))
    changed = sub.filter(~hit(37)).withColumn("score", F.col("score") + F.when(hit(29), 0.5).otherwise(0.0))
    st.write_submission(changed.unionByName(foreign), path, "ordinal", ["row_id", "score"])
    back = spark.read.schema("row_id long, score double").option("header", True).csv(path)
    both = back.join(sub.select("row_id", F.col("score").alias("src")), "row_id", "full_outer")
    return both.agg(F.count("score").alias("n"), F.round(F.max(F.abs(F.col("score") - F.col("src"))), 6).alias("max_diff"),
                    F.sum(F.col("score").isNull().cast("long")).alias("n_missing"), F.sum(F.col("src").isNull().cast("long")).alias("n_unknown"))


@query("fn07_determinism")
def determinism(spark, folder):
    frame = fr.score_frame(spark, folder)
    one = pb.content_hash(fr.prediction_frame(frame), value="pred_a").withColumn("run", F.lit(1))
    two = pb.content_hash(fr.prediction_frame(frame.repartition(7, "row_id")), value="pred_a").withColumn("run", F.lit(2))
    return one.unionByName(two)


@query("fn08_gap_ledger", with_blocks(
    "SELECT model, cv_mean, round(rw_mse - cv_mean, 6) AS gap, CASE WHEN abs(rw_mse - cv_mean) <= 1.5 * cv_std THEN 'green' WHEN abs(rw_mse - cv_mean) <= 3 * cv_std THEN 'yellow' ELSE 'red' END AS status FROM led", "folds", "preds_long", "scored", extra=LB))
def gap_ledger(spark, folder):
    led = _ledger(spark, folder)
    return rounded(pb.gap_row(led, F.col("rw_mse")).select("model", "cv_mean", "gap", "status"))


@query("fn09_impute_contract", with_blocks(
    "SELECT 3 * count(*) FILTER (WHERE row_id % 37 = 0 AND disc_pts IS NOT NULL) AS n_null, 3 * count(*) FILTER (WHERE row_id % 29 = 0 AND ret_qty IS NULL) AS n_zero_bad, "
    "3 * count(*) FILTER (WHERE row_id % 31 = 0 AND (avg_qty IS NULL OR row_id % 5 = 0)) AS n_median_bad, 3 * count(*) FILTER (WHERE row_id % 23 = 0) AS n_flag_bad FROM train", "train"))
def impute_contract(spark, folder):
    """Planted faults in a filled table: gaps left, a structural zero changed, a median changed, a flag turned."""
    _, train, folds = train_and_folds(spark, folder)
    med, zero = ["avg_qty", "disc_pts"], ["ret_qty"]
    hit = lambda n: F.col("row_id") % n == 0
    raw = pin(train.select("row_id", *med, *zero).withColumn("avg_qty", F.when(~hit(5), F.col("avg_qty"))))
    clean = en.impute_cells(raw, folds, med, zero)
    faulty = clean.withColumns({
        "disc_pts": F.when(~(hit(37) & (F.col("disc_pts_missing") == 0)), F.col("disc_pts")),
        "ret_qty": F.when(hit(29) & (F.col("ret_qty_missing") == 1), F.lit(1.0)).otherwise(F.col("ret_qty")),
        "avg_qty": F.col("avg_qty") + F.when(hit(31) & (F.col("avg_qty_missing") == 1), 1.0).otherwise(0.0),
        "avg_qty_missing": F.when(hit(23), 1 - F.col("avg_qty_missing")).otherwise(F.col("avg_qty_missing")),
    })
    return pb.impute_contract(faulty, en.cell_medians(raw, folds, med), raw, folds, med, zero)
