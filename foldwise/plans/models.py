"""Model-fitting queries: out-of-fold jobs and the probes built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.solvers import ridge_from_moments
from ..operators import folds as fo
from ..operators import gram as gr
from ..operators import metrics as mt
from ..operators import oof
from ..session import lookup, pin, stored
from ..sources import frame as fr
from .registry import query

ONE = (42,)
Y = fr.PLANTED


def record_table(spark, folder):
    """The record frame, joined once and stored, for sums that do not depend on the order of rows."""
    return stored(fr.score_frame(spark, folder), "records")


def frame_and_folds(spark, folder, seeds=ONE, target=Y):
    """The record frame and its folds, made once: folds, indexers and matrices all read them.

    Both are pinned, which keeps the layout of their rows: the sampling of the trees depends on it.
    """
    frame = pin(fr.score_frame(spark, folder))
    return frame, pin(fo.stratified_folds(fr.train_rows(frame), target, seeds=seeds))


def model_table(data):
    """A model table written once; its rows keep their order, which the sampling of the trees depends on."""
    return stored(data, "model")


def prepared(spark, folder, seeds=ONE, target=Y, **kw):
    frame, folds = frame_and_folds(spark, folder, seeds, target)
    return model_table(oof.model_frame(frame, folds, target, **kw))


def rows(scored):
    return scored.select("row_id", "split", "y", "pred")


@query("md01_oof_runner")
def oof_runner(spark, folder):
    """Three repeats of five folds with shallow boosted trees; one row per record."""
    data = prepared(spark, folder, fo.SEEDS)
    return rows(oof.run_oof(data, oof.gbt(maxIter=5, maxDepth=3), 3))


@query("md02_boosted_trees")
def boosted(spark, folder):
    return oof.quality(oof.run_oof(prepared(spark, folder), oof.staged_gbt(maxIter=12, stepSize=0.4), 1), "gbt")


@query("md02b_rounds_ledger")
def rounds_ledger(spark, folder):
    """Rounds tried and kept in every cell of three repeats."""
    fitted = oof.fit_all(prepared(spark, folder, fo.SEEDS), oof.staged_gbt(maxIter=12, maxDepth=3, stepSize=0.5, patience=3), 3)
    return spark.createDataFrame(oof.rounds_ledger(fitted), "repeat int, fold int, rounds_tried int, rounds_kept int, validation_mse double")


@query("md03_weighted_boosting")
def weighted_boosting(spark, folder):
    frame, folds = frame_and_folds(spark, folder)
    train = fr.train_rows(frame)
    w = mt.importance_weights(train.select("row_id", "cohort_year"), fr.test_rows(frame), "cohort_year").select("row_id", F.least(F.greatest("w", F.lit(0.1)), F.lit(5.0)).alias("w"))
    data = oof.model_frame(frame, folds, Y).join(w, "row_id", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    return oof.quality(oof.run_oof(model_table(data), oof.staged_gbt(weight="w", maxIter=12, stepSize=0.4), 1), "gbt_weighted")


@query("md04_huber_boosting")
def huber_boosting(spark, folder):
    data = prepared(spark, folder)
    plain = oof.quality(oof.run_oof(data, oof.huber_boost(5.0, rounds=8, rate=0.5), 1), "huber")
    tight = oof.quality(oof.run_oof(data, oof.huber_boost(5.0, rounds=8, rate=0.5, depth=3, min_rows=80), 1), "huber_tight")
    return plain.unionByName(tight)


@query("md05_other_tree_families")
def other_families(spark, folder):
    data = prepared(spark, folder)
    a = oof.quality(oof.run_oof(data, oof.forest(), 1), "forest")
    b = oof.quality(oof.run_oof(data, oof.gbt(maxDepth=6, maxIter=6, stepSize=0.3), 1), "deep_gbt")
    return a.unionByName(b)


NUMS = list(fr.NUMERICS)


def numeric_moments(spark, folder, target=Y, columns=NUMS, seeds=fo.SEEDS, where=None):
    df = numeric_rows(spark, folder, target, columns, seeds)
    used = df if where is None else df.filter(where)
    return df, gr.cell_moments(used, list(columns), target)


def numeric_rows(spark, folder, target=Y, columns=NUMS, seeds=fo.SEEDS):
    """Training rows with filled numerics and their fold numbers."""
    frame = record_table(spark, folder)
    folds = fo.stratified_folds(fr.train_rows(frame), target, seeds=seeds)
    filled = fr.train_rows(frame).select("row_id", "segment", target, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return stored(gr.with_fold_array(filled, folds), "numeric")


@query("md06_ridge_oof")
def ridge_oof(spark, folder):
    df, m = numeric_moments(spark, folder)
    p = gr.held_out_column(NUMS, gr.fit_cells(m, lambda t: ridge_from_moments(t, 1.0)))
    return df.select("row_id", F.col(Y).alias("y"), p.alias("pred"))


INTERIOR = f"{Y} > 0.5 AND {Y} < 99.5"


@query("md07_least_squares")
def least_squares(spark, folder):
    df, out = numeric_rows(spark, folder, seeds=ONE), []
    for name, where in (("all", None), ("interior", INTERIOR)):
        rep = gr.ols_report(gr.cell_moments(df if where is None else df.filter(where), NUMS, Y))
        out += [(name, c, float(b), float(s), rep["r2"], rep["resid_std"]) for c, b, s in zip(NUMS, rep["coef"], rep["std_coef"])]
    return spark.createDataFrame(out, "subset string, column string, coef double, std_coef double, r2 double, resid_std double")


@query("fx12_weight_dispersion")
def weight_dispersion(spark, folder):
    from ..operators.profile import ranges

    df, m = numeric_moments(spark, folder, seeds=ONE, where=INTERIOR)
    coef = gr.ols_report(m)["coef"]
    table = spark.createDataFrame([(c, float(b)) for c, b in zip(NUMS, coef)], "column string, coef double")
    j = ranges(df, NUMS).join(F.broadcast(table), "column").select("column", "coef", (F.col("coef") * (F.col("hi") - F.col("lo"))).alias("contribution"), "score_like")
    stats = j.filter("score_like").agg(F.struct(F.sum("coef").alias("s"), (F.stddev_samp("coef") / F.abs(F.avg("coef"))).alias("cv"))).scalar()
    return j.select("*", stats["s"].alias("score_weight_sum"), stats["cv"].alias("score_weight_cv"))


@query("fx13_extra_term_gain")
def extra_term_gain(spark, folder):
    frame = record_table(spark, folder)
    train = fr.train_rows(frame).filter(INTERIOR)
    c = {k: F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k in NUMS}
    terms = {"lines_x_qty": c["n_lines"] * c["avg_qty"], "lines_sq": c["n_lines"] * c["n_lines"], "qty_sq": c["avg_qty"] * c["avg_qty"]}
    df = train.select(Y, F.array(F.lit(0)).alias("folds"), *[v.alias(k) for k, v in {**c, **terms}.items()])
    m = gr.cell_moments(df, [*NUMS, *terms], Y)
    base = gr.ols_report(m, NUMS)["r2"]
    return spark.createDataFrame([(t, base, gr.ols_report(m, [*NUMS, t])["r2"], gr.ols_report(m, [*NUMS, t])["r2"] - base) for t in terms], "term string, r2_base double, r2 double, gain double")


@query("md10_cap_classifier")
def cap_classifier(spark, folder):
    frame, folds = frame_and_folds(spark, folder)
    data = oof.model_frame(frame, folds, Y).withColumn("y", (F.col("y") >= 95.0).cast("double"))
    scored = oof.run_oof(model_table(data), oof.classifier(), 1, lo=0.0, hi=1.0)
    return mt.roc_auc(scored.select("split", "y", "pred"), "y", "pred", ["split"], (0.0, 1.0))


def drift_aucs(spark, folder, years, categories=True):
    frame = pin(fr.score_frame(spark, folder))
    lab = frame.withColumn("is_test", (F.col("split") == "test").cast("int"))
    folds = fo.assign_folds(lab.select("row_id", F.col("is_test").alias("bin")), seeds=ONE)
    # both sides are scored out of fold, so every row is a training row of this task
    data = oof.model_frame(frame, folds, Y, years=years, categories=categories).withColumn("y", (F.col("split") == "test").cast("double")).withColumn("split", F.lit("train"))
    scored = pin(oof.run_oof(model_table(data), oof.classifier(maxIter=5), 1, lo=0.0, hi=1.0).select("row_id", "y", "pred", F.col("folds")[0].alias("fold")))
    pooled = mt.roc_auc(scored, "y", "pred", (), (0.0, 1.0)).withColumnRenamed("auc", "auc_pooled")
    mean = mt.roc_auc(scored, "y", "pred", ["fold"], (0.0, 1.0)).agg(F.avg("auc")).scalar()
    return pooled.select("auc_pooled", mean.alias("auc_fold_mean"))


@query("pr16_adversarial_sets")
def adversarial_sets(spark, folder):
    out = None
    for name, years, cats in (("numeric", False, False), ("structured", False, True), ("with_years", True, True)):
        part = drift_aucs(spark, folder, years, cats).withColumn("columns", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("md11_drift_classifier")
def drift_classifier(spark, folder):
    return drift_aucs(spark, folder, True)


@query("pr17_permutation_importance")
def permutation_importance(spark, folder):
    """AUC drop of the drift classifier when one column is shuffled: every column, mean over five repeats."""
    frame, folds = frame_and_folds(spark, folder)
    names = [*fr.NUMERICS, *fr.YEARS]
    model = oof.model_frame(frame, folds, Y)
    data = stored(model.withColumn("y", (F.col("split") == "test").cast("double")).select("row_id", "y", "features"), "model")
    flags = [f"{c}_missing" for c in fr.NULLABLE]
    scorer = oof.classifier(maxIter=5)(data)
    base = mt.roc_auc(scorer(data, "p").select("y", "p"), "y", "p", (), (0.0, 1.0)).first()["auc"]
    names += flags + list(fr.CATEGORIES)
    trials = scorer(oof.permuted(data, range(100, 105), len(names)), "p").select("y", "p", "seed", "position")
    auc = mt.roc_auc(trials, "y", "p", ("position", "seed"), (0.0, 1.0))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("position") + 1)
    return auc.groupBy(name.alias("column")).agg((F.lit(base) - F.avg("auc")).alias("auc_drop")).orderBy(F.desc("auc_drop"))


@query("md12_residual_model")
def residual_model(spark, folder):
    """A second channel fitted on the residual of the first, against the joint fit."""
    df, m = numeric_moments(spark, folder)
    first, second = ["n_lines"], [c for c in NUMS if c != "n_lines"]
    solve = lambda t: ridge_from_moments(t, 1.0)
    base = pin(df.withColumn("p1", gr.held_out_column(first, gr.fit_cells(m.subset(first), solve))).withColumn("resid", F.col(Y) - F.col("p1")))
    res = gr.held_out_column(second, gr.fit_cells(gr.cell_moments(base, second, "resid"), solve))
    joint = gr.held_out_column(NUMS, gr.fit_cells(m, solve))
    s = gr.weighted_score(base, {"first": F.col("p1"), "additive": F.col("p1") + res, "joint": joint}, Y, None)
    v = base.agg(F.var_pop("resid").alias("v"), F.avg((F.col("resid") - res) * (F.col("resid") - res)).alias("e")).first()
    return spark.createDataFrame([(k, s[k], float(1 - v["e"] / v["v"])) for k in s], "model string, mse double, residual_r2 double")


def on_residual(spark, folder, second, target):
    first = oof.gbt(maxIter=5, maxDepth=3)
    return oof.two_stage(prepared(spark, folder), first, second, target, 1)


@query("fx19_residual_learnability")
def residual_learnability(spark, folder):
    """Out-of-fold share of residual variance explained by the other columns."""
    both = on_residual(spark, folder, oof.gbt(maxIter=5), lambda y, p: y - p).filter("split = 'train'")
    left = F.col("y") - F.col("p1")
    return both.agg(F.count("*").alias("n"), (1 - F.avg((left - F.col("p2")) * (left - F.col("p2"))) / F.var_pop(left)).alias("r2"))


@query("fx18_residual_sign")
def residual_sign(spark, folder):
    """Can the sign of the residual be predicted?  AUC and accuracy in the most confident slices."""
    from ..operators.ranks import bin_of, quantile_edges

    both = on_residual(spark, folder, oof.classifier(maxIter=5), lambda y, p: (y > p).cast("double")).filter("split = 'train'")
    sc = pin(both.select((F.col("y") > F.col("p1")).cast("double").alias("y"), F.col("p2").alias("pred"), F.abs(F.col("p2") - 0.5).alias("conf")))
    auc = mt.roc_auc(sc, "y", "pred", (), (0.0, 1.0)).scalar()
    hit = ((F.col("pred") > 0.5).cast("double") == F.col("y")).cast("double")
    return sc.groupBy(bin_of("conf", quantile_edges(sc, "conf", 4, (0.0, 0.5))).alias("slice")).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy")).select("*", auc.alias("auc"))


def cell_scores(data, fit, n_repeats):
    """MSE of every (repeat, fold) cell, each by its own fit."""
    out = None
    for r in range(n_repeats):
        one = data.withColumn("folds", F.slice("folds", r + 1, 1))
        with oof.kept(data):
            scored = oof.run_oof(one, fit, 1).filter("split = 'train'")
        part = scored.groupBy(F.lit(r).alias("repeat"), F.col("folds")[0].alias("fold")).agg(F.avg((F.col("y") - F.col("pred")) * (F.col("y") - F.col("pred"))).alias("mse"))
        out = part if out is None else out.unionByName(part)
    return out


def with_columns(spark, folder, sets, name, fit=None, seeds=ONE):
    """Score several extra-column sets with one estimator (an ablation driver)."""
    frame, folds = frame_and_folds(spark, folder, seeds)
    out = None
    for label, (extra, cols) in sets(frame).items():
        data = model_table(oof.model_frame(frame, folds, Y, extra=extra, extra_cols=cols))
        cells = cell_scores(data, fit or oof.gbt(maxIter=5, maxDepth=3), len(seeds))
        part = cells.agg(F.avg("mse").alias("cv_mean"), F.stddev_pop("mse").alias("cv_std")).withColumn(name, F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def gated(table, name, incumbent):
    """Which sets pass the gate against the incumbent, and the lowest of those (the incumbent if none does)."""
    table = pin(table)
    a = table.filter(F.col(name) == incumbent).agg(F.struct(F.first("cv_mean").alias("m"), F.first("cv_std").alias("s"))).scalar()
    judged = pin(table.select(name, "cv_mean", "cv_std", mt.acceptance_gate(F.col("cv_mean"), a["m"], a["s"]).alias("accepted")))
    best = judged.filter(F.col("accepted") | (F.col(name) == incumbent)).agg(F.min(F.struct(~F.col("accepted"), "cv_mean", name)).alias("b")).select(f"b.{name}").scalar()
    return judged.select("*", (F.col(name) == best).alias("selected"))


@query("fe26_group_ablation")
def group_ablation(spark, folder):
    """Anchor, core, core plus group on all 15 cells; each gated against the anchor, the lowest passing set selected."""
    from ..operators.features import derived

    groups = {"anchor": [], "core": ["qty_mean", "pts_mean"], "core+std": ["qty_mean", "pts_mean", "all_std"], "core+products": ["qty_mean", "pts_mean", "lines_x_qty"]}
    table = with_columns(spark, folder, lambda f: {k: (derived(f) if v else None, v) for k, v in groups.items()}, "feature_set", oof.gbt(maxIter=4, maxDepth=3), fo.SEEDS)
    return gated(table, "feature_set", "anchor")


@query("fe27_encoding_ablation")
def encoding_ablation(spark, folder):
    """Every category as index, as one-hot columns and as out-of-fold target means under one estimator; gated against the indices."""
    from ..operators import encoders as en
    from pyspark.ml.functions import array_to_vector

    frame, folds = frame_and_folds(spark, folder)
    train = fr.train_rows(frame)
    fit = oof.gbt(maxIter=5, maxDepth=3)
    plain = model_table(oof.model_frame(frame, folds, Y, categories=False, keep=fr.CATEGORIES))
    coded, width = en.sparse_one_hot(frame.select("row_id", *fr.CATEGORIES), train, fr.CATEGORIES)
    ones = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains("onehot", i).cast("double"))
    hot = _append(plain.join(coded.select("row_id", array_to_vector(ones).alias("hot")), "row_id"), ["hot"])
    found = {"native": cell_scores(model_table(oof.model_frame(frame, folds, Y)), fit, 1), "one_hot": cell_scores(model_table(hot), fit, 1)}

    # target means: training rows of a cell carry the inner cross-fitted value, held-out rows the cell value
    inner = fo.inner_split("row_id", 42, 0)
    base = plain.withColumn("inner", inner)
    cross = {c: pin(en.cross_fitted_encoding(train, folds, c, Y, inner).select("fold", "inner", c, F.col("enc").alias(f"enc_{c}"))) for c in fr.CATEGORIES}
    cell = {c: pin(en.target_encoding(train, folds, c, Y).select("fold", c, F.col("enc").alias(f"enc_{c}"))) for c in fr.CATEGORIES}
    names, fitted = [f"enc_{c}" for c in fr.CATEGORIES], {}
    for f in range(fo.N_FOLDS):
        tr = oof.cell_training(base, 0, f)
        for c, t in cross.items():
            tr = tr.join(lookup(t.filter(F.col("fold") == f).drop("fold")), ["inner", c], "left")
        fitted[(0, f)] = _encoded_scorer(fit(_append(tr, names)), {c: lookup(t.filter(F.col("fold") == f).drop("fold")) for c, t in cell.items()})
    scored = oof.score_cells(base, fitted).filter("split = 'train'")
    found["target_mean"] = scored.groupBy(F.lit(0).alias("repeat"), F.col("folds")[0].alias("fold")).agg(F.avg((F.col("y") - F.col("pred")) * (F.col("y") - F.col("pred"))).alias("mse"))
    out = None
    for label, cells in found.items():
        part = cells.agg(F.avg("mse").alias("cv_mean"), F.stddev_pop("mse").alias("cv_std")).withColumn("encoding", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return gated(out, "encoding", "native")


def _append(df, columns):
    """The feature vector with more columns (numbers, gaps as zero, or vectors) behind it."""
    from pyspark.ml.feature import VectorAssembler

    kinds = dict(df.dtypes)
    filled = df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns if kinds[c] == "double"})
    v = VectorAssembler(inputCols=["features", *columns], outputCol="_fx").transform(filled)
    return v.drop("features", *columns).withColumnRenamed("_fx", "features")


def _encoded_scorer(model, tables):
    def score(df, out):
        names, given = df.columns, df
        for c, t in tables.items():
            given = given.join(t, c, "left")
        done = model(_append(given.withColumn("_plain", F.col("features")), [f"enc_{c}" for c in tables]), out)
        return done.drop("features").withColumnRenamed("_plain", "features").select(*names, out)

    return score


@query("fe38_null_importance")
def null_importance(spark, folder):
    """Columns that beat 20 shuffled targets and repeat no better column, decided in every fold's training part."""
    import numpy as np

    frame, folds = frame_and_folds(spark, folder)
    names = [*fr.NUMERICS, *fr.YEARS]
    data = model_table(oof.model_frame(frame, folds, Y, categories=False))
    found = oof.null_importance(data.filter("split = 'train'"), len(names))
    filled = fr.train_rows(frame).select("row_id", Y, *[F.coalesce(F.col(c).cast("double"), F.lit(oof.MISSING)).alias(c) for c in names])
    moments = gr.cell_moments(gr.with_fold_array(filled, folds), names, Y)
    out = []
    for fold, (real, null) in sorted(found.items()):
        m = moments.training(0, fold)
        mean = m[0, 1:-1] / m[0, 0]
        twin = oof.correlation_drop(m[1:-1, 1:-1] / m[0, 0] - np.outer(mean, mean), real, 0.97)
        for i, n in enumerate(names):
            share = float((null[:, i] < real[i]).mean())
            out.append((fold, n, float(real[i]), float(null[:, i].mean()), share, names[twin[i]] if i in twin else None, share >= 0.95 and i not in twin))
    return spark.createDataFrame(out, "fold int, column string, importance double, null_importance double, nulls_beaten double, repeats string, kept boolean")


@query("md13_meta_headroom")
def meta_headroom(spark, folder):
    preds = lambda f: fr.prediction_frame(f)
    return with_columns(spark, folder, lambda f: {
        "num": (None, []), "num+a": (preds(f), ["pred_a"]), "num+e": (preds(f), ["pred_e"]), "num+a+e": (preds(f), ["pred_a", "pred_e"])}, "columns")


@query("md14_low_tail_weights")
def low_tail_weights(spark, folder):
    data = prepared(spark, folder)
    out = None
    for k in (0.0, 1.0, 3.0):
        weighted = data.withColumn("w", 1.0 + k * (F.col("y") <= 50).cast("double"))
        part = oof.quality(oof.run_oof(weighted, oof.gbt(weight="w", maxIter=5, maxDepth=3), 1), f"k={k:g}")
        out = part if out is None else out.unionByName(part)
    return out


def pseudo(spark, folder, keep, name):
    """Test rows labelled inside every cell by a blend of two families."""
    data = prepared(spark, folder)
    labelers = (oof.gbt(maxIter=5, maxDepth=3), oof.forest(numTrees=10))
    fit = oof.pseudo_labelled(data, oof.gbt(weight="_w", maxIter=5, maxDepth=3), labelers, 0.3, keep)
    return oof.quality(oof.run_oof(data, fit, 1), name)


@query("md15_pseudo_labels")
def pseudo_labels(spark, folder):
    return pseudo(spark, folder, 1.0, "pseudo")


@query("md16_confident_pseudo_labels")
def confident_pseudo_labels(spark, folder):
    """Only the half of the test rows on which the two families agree most is labelled."""
    return pseudo(spark, folder, 0.5, "pseudo_confident")


@query("md17_seed_bagging")
def seed_bagging(spark, folder):
    return oof.quality(oof.run_oof(prepared(spark, folder), oof.bagged(lambda s: oof.gbt(seed=s, maxIter=4, maxDepth=3), (1, 2, 3)), 1), "bagged")


@query("md18_two_stage")
def two_stage(spark, folder):
    data = prepared(spark, folder)
    soft = oof.quality(oof.run_oof(data, oof.binned(4, regress=True), 1), "soft")
    return soft.unionByName(oof.quality(oof.run_oof(data, oof.binned(4, regress=True, hard=True), 1), "hard"))


@query("md19_bin_probability")
def bin_probability(spark, folder):
    return oof.quality(oof.run_oof(prepared(spark, folder), oof.binned(64, regress=False), 1), "bin_expectation")


@query("md20_cluster_then_predict")
def cluster_then_predict(spark, folder):
    return oof.quality(oof.run_oof(prepared(spark, folder), oof.clustered(), 1), "clustered")


@query("md21_residual_chain")
def residual_chain(spark, folder):
    both = on_residual(spark, folder, oof.gbt(maxIter=5, maxDepth=3), lambda y, p: y - p)
    return oof.quality(both.select("row_id", "split", "y", gr.clip(F.col("p1") + F.col("p2")).alias("pred")), "chain")


@query("md22_augmentation")
def augmentation(spark, folder):
    data = prepared(spark, folder)
    base = oof.gbt(maxIter=5, maxDepth=3)
    n = len(fr.NUMERICS) + len(fr.YEARS)
    out = oof.quality(oof.run_oof(data, base, 1), "none")
    for name, make in (("mixup", lambda t: oof.mixed_up(t, n)), ("jitter", lambda t: oof.jittered(t, n, 0.05, 5)), ("mask", lambda t: oof.masked(t, n)),
                       ("neighbours", lambda t: oof.neighbour_mixed(t, n)), ("tail_neighbours", lambda t: oof.neighbour_mixed(t, n, tail=50.0))):
        out = out.unionByName(oof.quality(oof.run_oof(data, oof.augmented(base, make), 1), name))
    return out


@query("md23_spline_ridge")
def spline_ridge(spark, folder):
    """Additive splines of all numerics; the knots are quantiles of each cell's training rows."""
    from ..operators.ranks import training_quantiles

    frame, folds = frame_and_folds(spark, folder)
    train = fr.train_rows(frame)
    df = pin(gr.with_fold_array(train.select("row_id", Y, *[F.col(c).cast("double").alias(c) for c in NUMS]), folds))
    long = df.unpivot(["folds"], NUMS, "column", "value")
    rows_ = training_quantiles(long, "value", (0.0, 0.25, 0.5, 0.75, 1.0), ["column"], n_repeats=1, digits=6).collect()
    knots, scale = {}, {}
    for r in rows_:
        lo, hi = r["q0"], r["q4"]
        inner = sorted({r[f"q{i}"] for i in (1, 2, 3)} - {lo, hi})
        knots.setdefault((r["repeat"], r["fold"]), {})[r["column"]] = inner
        scale.setdefault((r["repeat"], r["fold"]), {})[r["column"]] = (lo, hi - lo if hi > lo else 1.0)

    def basis(cell):
        out = []
        for c in NUMS:
            lo, width = scale[cell][c]
            at = lambda x, lo=lo, width=width: (x - F.lit(lo)) / F.lit(width)
            v = F.coalesce(at(F.col(c)), F.lit(0.0))
            out += [v, v * v, *[F.greatest(v - F.lit((k - lo) / width), F.lit(0.0)) for k in knots[cell][c]]]
        return out

    done = gr.cell_basis_ridge(df, basis, Y, 1.0, sorted(knots))
    return done.select("row_id", F.col(Y).alias("y"), "pred")


@query("en10_nonlinear_meta")
def nonlinear_meta(spark, folder):
    """Trees over out-of-fold columns with the gap between fitted and held-out error."""
    from pyspark.ml.feature import VectorAssembler

    from .blends import stack

    df = VectorAssembler(inputCols=list(fr.MODELS), outputCol="features").transform(stack(spark, folder)).select(
        "row_id", F.lit("train").alias("split"), F.col(fr.TARGET).alias("y"), "folds", "features")
    df = pin(df)
    out = []
    for name, fit in (("gbt", oof.gbt(maxIter=5)), ("forest", oof.forest())):
        held = oof.run_oof(df, fit, 1).agg(F.avg((F.col("y") - F.col("pred")) * (F.col("y") - F.col("pred"))).alias("m")).first()["m"]
        seen = fit(df)(df, "p").agg(F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("m")).first()["m"]
        out.append((name, float(seen), float(held), float(held - seen)))
    return spark.createDataFrame(out, "model string, mse_fitted double, mse_held_out double, overfit_gap double")


# ---- text, neighbours, censored regression ---------------------------------------


def text_folds(spark, folder, seeds=ONE):
    df = fr.text_frame(spark, folder)
    return df, fo.stratified_folds(fr.train_rows(df), fr.TARGET, seeds=seeds)


def penalties(spark, found):
    return spark.createDataFrame(found, "alpha double, mse double")


@query("tx14_alpha_selection")
def alpha_selection(spark, folder):
    from ..operators import text as te
    from ..operators import textridge as tr

    df, folds = text_folds(spark, folder)
    return penalties(spark, tr.select_alpha(df, folds, "text", fr.TARGET, [te.WORD]))


@query("tx14b_alpha_word_char")
def alpha_word_char(spark, folder):
    from ..operators import text as te
    from ..operators import textridge as tr

    df, folds = text_folds(spark, folder)
    return penalties(spark, tr.select_alpha(df, folds, "text", fr.TARGET, [te.WORD, te.CHAR]))


@query("tx14c_alpha_embedding")
def alpha_embedding(spark, folder):
    from ..operators import textridge as tr

    df, _ = embedding_rows(spark, folder)
    return penalties(spark, tr.vector_alpha(gr.cell_moments(df, F.col("embedding"), fr.TARGET), df, "embedding", fr.TARGET, EMBEDDING_ALPHAS))


@query("tx15_nested_word_ridge")
def nested_word_ridge(spark, folder):
    """Three repeats, five folds, five inner parts: 75 ridges in one solver."""
    from ..operators import text as te
    from ..operators import textridge as tr

    df, folds = text_folds(spark, folder, fo.SEEDS)
    return tr.nested_text_ridge(df, folds, "text", fr.TARGET, [te.WORD]).drop("folds")


@query("tx15b_ridge_residuals")
def ridge_residuals(spark, folder):
    """What each system's solution leaves of its right side, relative to it."""
    from ..operators import text as te
    from ..operators import textridge as tr

    df, folds = text_folds(spark, folder)
    cells = tr.text_cells(df, folds, "text", fr.TARGET, [te.WORD], nested=False)
    found = tr.residuals(tr.fit_text(cells, tr.ALPHAS), cells, tr.ALPHAS)
    return spark.createDataFrame(found, "repeat int, fold int, inner int, alpha double, residual double")


@query("tx16_nested_rich_ridge")
def nested_rich_ridge(spark, folder):
    from ..operators import text as te
    from ..operators import textridge as tr

    df, folds = text_folds(spark, folder, fo.SEEDS)
    return oof.quality(tr.nested_text_ridge(df, folds, "text", fr.TARGET, [te.RICH_WORD, te.RICH_CHAR]), "rich")


@query("tx17_nested_word_char_ridge")
def nested_word_char_ridge(spark, folder):
    from ..operators import text as te
    from ..operators import textridge as tr

    df, folds = text_folds(spark, folder, fo.SEEDS)
    alphas = tr.select_alpha(df, folds, "text", fr.TARGET, [te.WORD, te.CHAR])
    best = min(alphas, key=lambda t: t[1])[0]
    return oof.quality(tr.nested_text_ridge(df, folds, "text", fr.TARGET, [te.WORD, te.CHAR], alpha=best), "word_char")


EMBEDDING_ALPHAS = (0.1, 1.0, 10.0)


def embedding_rows(spark, folder):
    emb = fr.embedding_frame(spark, folder)
    return pin(gr.with_fold_array(fr.train_rows(emb), fo.stratified_folds(fr.train_rows(emb), fr.TARGET))), emb


@query("tx18_embedding_ridge")
def embedding_ridge(spark, folder):
    from ..operators import textridge as tr

    df, emb = embedding_rows(spark, folder)
    alphas = tr.vector_alpha(gr.cell_moments(df, F.col("embedding"), fr.TARGET), df, "embedding", fr.TARGET, EMBEDDING_ALPHAS)
    best = min(alphas, key=lambda t: t[1])[0]
    fitted, pred = tr.nested_vector_ridge(df, "embedding", fr.TARGET, best, 3)
    import numpy as np

    coef, inter = np.mean([c for c, _ in fitted.values()], axis=0), float(np.mean([b for _, b in fitted.values()]))
    test = fr.test_rows(emb).select("row_id", "split", F.col(fr.TARGET).alias("y"), gr.clip(gr.linear_vector("embedding", coef, inter)).alias("pred"))
    return df.select("row_id", "split", F.col(fr.TARGET).alias("y"), pred.alias("pred")).unionByName(test)


@query("tx19_text_ablation")
def text_ablation(spark, folder):
    """Structured columns alone, with the lexicon, with the nested ridge, and with both, as tree models; word and short character ridge alone."""
    from ..operators import text as te
    from ..operators import textridge as tr
    from ..operators.features import Roles

    df, folds = text_folds(spark, folder, fo.SEEDS)
    # the raw lengths would give this stand-in target away
    words = [c for c in te.HANDCRAFTED if c not in ("len_char", "len_word")]
    ridge = pin(tr.nested_text_ridge(df, folds, "text", fr.TARGET, [te.WORD]))
    joined = fr.text_structure(df).join(te.handcrafted(df, "text").select("row_id", *words), "row_id").join(ridge.select("row_id", F.col("pred").alias("txt")), "row_id")
    joined = pin(joined)
    roles = Roles(categories=("lang", "source"), years=(), zero_fill=(), median_fill=())
    out = oof.quality(ridge, "word_alone")
    for name, less in (("num", [*words, "txt"]), ("num+lexicon", ["txt"]), ("num+ridge", words), ("num+both", [])):
        data = pin(oof.model_frame(joined.drop(*less), folds, fr.TARGET, roles, years=False))
        out = out.unionByName(oof.quality(oof.run_oof(data, oof.gbt(maxIter=5, maxDepth=3), len(fo.SEEDS)), name))
    short = tr.nested_text_ridge(df, folds, "text", fr.TARGET, [te.CHAR_SHORT])
    return out.unionByName(oof.quality(short, "char_alone"))


DIRECTIONS = 80


def reduced_text(spark, folder):
    from ..operators import text as te
    from ..operators import textridge as tr

    df, folds = text_folds(spark, folder)
    cells = tr.text_cells(df, folds, "text", fr.TARGET, [te.WORD], nested=False, vectors=DIRECTIONS + 10)
    return tr.reduced_text(cells, DIRECTIONS)


@query("tx07_text_svd")
def text_svd(spark, folder):
    """Share of each row's squared length that the directions of a fold's training part keep."""
    rows_, parts, _ = reduced_text(spark, folder)
    each = rows_.select("split", F.posexplode("z").alias("part", "z"))
    fold = F.element_at(F.array(*[F.lit(f) for _, f, _ in parts]), F.col("part") + 1)
    energy = F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)
    return each.groupBy(fold.alias("fold"), "split").agg(F.count("*").alias("n"), F.avg(energy).alias("explained"))


@query("md08_svd_boosting")
def svd_boosting(spark, folder):
    """Boosted trees on text reduced inside each cell."""
    from pyspark.ml.functions import array_to_vector

    rows_, parts, _ = reduced_text(spark, folder)
    rows_, out = pin(rows_), None
    for j, (r, f, _) in enumerate(parts):
        data = pin(rows_.select("row_id", "split", "y", "folds", array_to_vector(F.col("z")[j]).alias("features")))
        scorer = oof.gbt(maxIter=5, maxDepth=3)(oof.cell_training(data, r, f))
        part = scorer(data, "pred").filter((F.col("split") == "test") | (F.col("folds")[r] == f)).select("row_id", "split", "y", "pred")
        out = part if out is None else out.unionByName(part)
    per_row = out.groupBy("row_id", "split").agg(F.first("y").alias("y"), F.avg("pred").alias("pred"))
    return oof.quality(pin(per_row), "svd_gbt")


@query("md09_censored_regression")
def censored_regression(spark, folder):
    from ..operators.censored import expected_below_cap, fit_censored
    from ..functions.rowwise import dot

    df, _ = numeric_moments(spark, folder, seeds=ONE)
    std = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in NUMS]).first()
    z = pin(df.select("row_id", Y, *[((F.col(c) - std[c]["m"]) / std[c]["s"]).alias(c) for c in NUMS]))
    beta, b0, sigma, value = fit_censored(z, NUMS, Y)
    mu = z.withColumn("mu", dot(NUMS, beta, b0))
    e = mu.withColumn("ey", gr.clip(expected_below_cap(F.col("mu"), sigma)))
    return e.agg(F.count("*").alias("n"), F.lit(sigma).alias("sigma"), F.lit(value).alias("log_likelihood"),
                 F.avg((F.col(Y) - F.col("ey")) * (F.col(Y) - F.col("ey"))).alias("mse"), F.avg(F.when(F.col(Y) >= 100, F.col("ey"))).alias("ey_at_cap"))


@query("fe37_knn_target_mean")
def knn_target_mean(spark, folder):
    from ..operators.neighbours import knn_target_mean as knn

    emb = fr.embedding_frame(spark, folder)
    folds = fo.stratified_folds(fr.train_rows(emb), fr.TARGET, seeds=ONE)
    train = emb.join(folds, "row_id")
    refs = train.select(F.col("row_id").alias("id"), F.col("embedding").alias("vec"), F.col(fr.TARGET).alias("y"), F.col("fold").alias("g"))
    test = fr.test_rows(emb).select(F.col("row_id").alias("id"), F.col("embedding").alias("vec"), F.lit(-1).alias("g"))
    return knn(refs.select("id", "vec", "g").unionByName(test), refs, 50)


def profile_cells(spark, folder):
    """(cell, training rows, other rows) with numerics scaled by the cell's training part, one repeat; the others hold test rows too."""
    frame, folds = frame_and_folds(spark, folder)
    filled = frame.select("row_id", "split", F.col(Y).alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMS])
    data = pin(filled.join(fo.fold_array(folds), "row_id", "left"))
    out = []
    for f in range(fo.N_FOLDS):
        train = oof.cell_training(data, 0, f)
        std = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in NUMS]).first()
        vec = F.array(*[(F.col(c) - std[c]["m"]) / (std[c]["s"] or 1.0) for c in NUMS])
        shape = lambda d, v=vec: d.select(F.col("row_id").alias("id"), "split", v.alias("vec"), "y")
        out.append((f, shape(train), shape(data.filter((F.col("split") != "train") | (F.col("folds")[0] == f)))))
    return out


@query("fx20_twin_spread")
def twin_spread(spark, folder):
    """How far apart the targets of a held-out row and its nearest training profile are."""
    from ..operators.neighbours import exact_knn

    every = None
    for _, train, rest in profile_cells(spark, folder):
        asked = pin(rest.filter("split = 'train'"))
        near = exact_knn(asked.select("id", "vec", F.lit(-1).alias("g")), train.select("id", "vec", "y", F.lit(0).alias("g")), 1)
        part = pin(near.select("id", "dist", F.col("y").alias("y_twin")).join(asked.select("id", "y"), "id"))
        every = part if every is None else every.unionByName(part)
    return every.agg(
        F.count("*").alias("n"), F.avg("dist").alias("mean_dist"), F.avg(F.abs(F.col("y") - F.col("y_twin"))).alias("mean_abs_dy"), F.stddev_pop("y").alias("y_std"))


@query("md24_knn_and_quantile_base")
def knn_and_quantile(spark, folder):
    """Neighbour mean in principal-component space, fitted per cell, and a median (absolute-loss) tree base."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..operators.neighbours import knn_target_mean as knn

    every = None
    for _, train, rest in profile_cells(spark, folder):
        as_vector = lambda d: d.withColumn("f", array_to_vector("vec"))
        model = PCA(k=3, inputCol="f", outputCol="p").fit(as_vector(train))
        turned = lambda d, m=model: m.transform(as_vector(d)).select("id", "split", vector_to_array("p").alias("vec"), "y")
        asked = pin(turned(rest))
        near = knn(asked.select("id", "vec", F.lit(-1).alias("g")), turned(train).select("id", "vec", "y", F.lit(0).alias("g")), 30)
        part = pin(near.select("id", "knn_mean").join(asked.select("id", "split", "y"), "id"))
        every = part if every is None else every.unionByName(part)
    a = oof.quality(pin(every.groupBy("id", "split").agg(F.first("y").alias("y"), F.avg("knn_mean").alias("pred"))), "knn_pca")
    return a.unionByName(oof.quality(oof.run_oof(prepared(spark, folder), oof.gbt(lossType="absolute", maxIter=5), 1), "median_gbt"))
