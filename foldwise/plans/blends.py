"""Stacking and blend-family queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rowwise import clip, row_std, squared_error
from ..operators import blend as bl
from ..operators import gram as gr
from ..operators.ranks import exact_quantiles, with_ranks
from ..session import pin
from ..sources import frame as fr
from .metrics import scored
from .profiles import rounded
from .registry import query
from .sqlbase import with_blocks

M = list(fr.MODELS)
Y, W = fr.TARGET, "w"


def stack(spark, folder, extra=()):
    """Training predictions, weights and fold arrays, pinned for the repeated passes."""
    df, folds = scored(spark, folder)
    return pin(gr.with_fold_array(df.select("row_id", "cohort_year", "segment", Y, W, "p_cap", *M, *extra), folds))


def stacked(spark, folder):
    df = stack(spark, folder)
    return df, gr.cell_moments(df, M, Y, W)


def weights_table(spark, names, coef, intercept):
    rows = [(n, float(c)) for n, c in zip(names, coef)] + [("intercept", float(intercept))]
    return spark.createDataFrame(rows, "member string, weight double")


@query("en01_nnls")
def nnls(spark, folder):
    _, m = stacked(spark, folder)
    return weights_table(spark, M, *bl.METHODS["nnls"](m.total()))


@query("en02_ridge_pos")
def ridge_pos(spark, folder):
    _, m = stacked(spark, folder)
    return weights_table(spark, M, *bl.METHODS["ridge_pos"](m.total()))


@query("en03_nested_meta_oof")
def nested_meta(spark, folder):
    df, m = stacked(spark, folder)
    return df.select("row_id", Y, bl.meta_oof(m, M, "ridge_pos").alias("pred"))


@query("en04_candidate_records")
def candidates(spark, folder):
    df, m = stacked(spark, folder)
    return bl.candidate_record(df, m, {"nnls_full": (M, "nnls"), "ridge_pos_full": (M, "ridge_pos"), "pair": (M[:2], "nnls")}, Y, W)


def steps_table(spark, steps):
    return spark.createDataFrame([(a, b, c, float(d)) for a, b, c, d in steps], "step int, changed string, members array<string>, nested_rw double")


@query("en05_forward_selection")
def forward(spark, folder):
    df, m = stacked(spark, folder)
    return steps_table(spark, bl.forward_selection(df, m, M, Y, W))


@query("en06_choose_and_score_test")
def choose(spark, folder):
    df, m = stacked(spark, folder)
    members = bl.forward_selection(df, m, M, Y, W)[-1][2]
    options = {"nnls_full": (M, "nnls"), "ridge_pos_full": (M, "ridge_pos"), "greedy_nnls": (members, "nnls")}
    scores = bl.nested_scores(df, m, options, Y, W)
    name = min(scores, key=scores.get)
    cols, method = options[name]
    coef, intercept = bl.METHODS[method](m.subset(cols).total())
    test = fr.test_rows(fr.prediction_frame(fr.score_frame(spark, folder)))
    return bl.apply_weights(test, cols, coef, intercept).select("row_id", F.lit(name).alias("blend"), "pred")


@query("en07_backward_elimination")
def backward(spark, folder):
    df, m = stacked(spark, folder)
    return steps_table(spark, bl.backward_elimination(df, m, M, Y, W))


@query("en07b_subset_search")
def subset_search(spark, folder):
    """Best member subset of every size inside each cell; the size is chosen without the repeat that judges it."""
    _, m = stacked(spark, folder)
    return spark.createDataFrame(bl.subset_search(m, M), "held_repeat int, size int, members array<string>, rw_others double, rw_held double")


@query("en08_regularised_meta")
def regularised(spark, folder):
    df, m = stacked(spark, folder)
    return bl.candidate_record(df, m, {k: (M, k) for k in bl.METHODS}, Y, W)


@query("en08b_huber_meta")
def huber_meta(spark, folder):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df, _ = scored(spark, folder)
    x = VectorAssembler(inputCols=M, outputCol="x").transform(df)
    model = LinearRegression(featuresCol="x", labelCol=Y, weightCol=W, loss="huber", solver="l-bfgs", regParam=1e-4, epsilon=1.35).fit(x)
    return weights_table(spark, M, model.coefficients.toArray(), model.intercept)


SUBSETS = {
    "all": M, "no_noise": ["pred_a", "pred_b", "pred_c", "pred_e"], "top3": ["pred_a", "pred_b", "pred_e"], "abc": ["pred_a", "pred_b", "pred_c"],
    "ace": ["pred_a", "pred_c", "pred_e"], "ab": ["pred_a", "pred_b"], "ae": ["pred_a", "pred_e"], "be": ["pred_b", "pred_e"],
}


def _family_sql(subset, models):
    a = f"list_sort([{', '.join(models)}])"
    k = len(models)
    exprs = {
        "arithmetic": f"list_sum({a}) / {k}",
        "geometric": f"exp(list_sum(list_transform({a}, lambda x: ln(greatest(x, 1e-6)))) / {k})",
        "median": f"({a}[{(k - 1) // 2 + 1}] + {a}[{k // 2 + 1}]) / 2",
        **{bl.power_name(p): f"pow(list_sum(list_transform({a}, lambda x: pow(greatest(x, 1e-6), CAST({p} AS DOUBLE)))) / {k}, CAST({1 / p!r} AS DOUBLE))" for p in bl.POWERS},
        **{f"trimmed_{t}": f"list_sum({a}[{t + 1}:{k - t}]) / {k - 2 * t}" for t in (1, 2) if k > 2 * t},
    }
    return " UNION ALL ".join(
        f"SELECT '{subset}' AS subset, '{n}' AS blend, round(sum(w * pow(score - least(greatest({e}, 0), 100), 2)) / sum(w), 5) AS rw_mse FROM scored" for n, e in exprs.items())


@query("en09_blend_family", with_blocks(" UNION ALL ".join(_family_sql(s, m) for s, m in SUBSETS.items()), "scored"))
def blend_family(spark, folder):
    from ..operators.profile import melt

    df, _ = scored(spark, folder)
    out = None
    for s, models in SUBSETS.items():
        wide = df.select(Y, W, *[c.alias(n) for n, c in bl.family(models).items()])
        part = melt(wide, {n: F.sum(F.col(W) * squared_error(Y, n)) / F.sum(W) for n in bl.family(models)}, "blend", "rw_mse").withColumn("subset", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 5)


GRID = 100


@query("en09b_rank_quantile_map", with_blocks(
    f"SELECT row_id, round(q[i] + (pr * {GRID} - (i - 1)) * (q[least(i + 1, {GRID + 1})] - q[i]), 5) AS pred FROM (SELECT *, CAST(floor(pr * {GRID}) AS INTEGER) + 1 AS i FROM r), "
    f"(SELECT quantile_cont(score, [{', '.join(f'{i}.0/{GRID}' for i in range(GRID + 1))}]) AS q FROM ptrain)", "ptrain", extra={
        "r": "SELECT row_id, (percent_rank() OVER (ORDER BY pred_a) + percent_rank() OVER (ORDER BY pred_b) + percent_rank() OVER (ORDER BY pred_e)) / 3 AS pr FROM ptrain"}))
def rank_map(spark, folder):
    """Mean rank of three models mapped through the target's quantiles on a 101-point grid."""
    df = pin(fr.train_rows(fr.prediction_frame(fr.score_frame(spark, folder))).select("row_id", Y, "pred_a", "pred_b", "pred_e"))
    row = exact_quantiles(df, Y, [i / GRID for i in range(GRID + 1)], (), (0.0, 100.0)).first()
    q = F.array(*[F.lit(float(v)) for v in row])
    ranked = with_ranks(df, {"_a": ("pred_a", (0, 100)), "_b": ("pred_b", (0, 100)), "_e": ("pred_e", (0, 100))}, percent=True)
    pr = (F.col("_a") + F.col("_b") + F.col("_e")) / 3
    at = ranked.select("row_id", pr.alias("pr"), F.floor(pr * GRID).cast("int").alias("i"))
    hi = F.least(F.col("i") + 1, F.lit(GRID))
    return rounded(at.select("row_id", (q[F.col("i")] + (F.col("pr") * GRID - F.col("i")) * (q[hi] - q[F.col("i")])).alias("pred")), 5)


@query("en11_bagged_selection")
def bagged(spark, folder):
    """Weights of the bagged selection on all rows, with its nested score."""
    df, m = stacked(spark, folder)
    cells, whole = bl.bagged_selection(m, M)
    score = gr.weighted_score(df, {"bagged": clip(gr.held_out_column(M, cells))}, Y, W)["bagged"]
    return spark.createDataFrame([(n, float(w), score) for n, w in zip(M, whole)], "member string, weight double, nested_rw double")


@query("en12_segment_weights")
def segment_weights(spark, folder):
    df, m = stacked(spark, folder)
    return bl.segment_weights(df, M, Y, W, "segment", m).withColumn("glob", bl.meta_oof(m, M, "ridge_pos")).groupBy("segment").agg(
        F.count("*").alias("n"), F.avg(squared_error(Y, "seg")).alias("mse_segment"), F.avg(squared_error(Y, "glob")).alias("mse_global"))


def _expanded(spark, folder, make):
    df, base = stacked(spark, folder)
    wide = df.select("*", *[c.alias(n) for n, c in make.items()])
    cols = [*M, *make]
    m = gr.cell_moments(wide, cols, Y, W)
    s = gr.weighted_score(wide, {"base": bl.meta_oof(base, M, "ridge_pos"), "expanded": clip(gr.held_out_column(cols, gr.fit_cells(m, bl.METHODS["ridge"])))}, Y, W)
    return spark.createDataFrame(sorted(s.items()), "blend string, nested_rw double")


@query("en13_year_interactions")
def year_interactions(spark, folder):
    late = (F.col("cohort_year") >= fr.LATE_YEAR).cast("double")
    return _expanded(spark, folder, {f"{m}_late": F.col(m) * late for m in M})


@query("en14_meta_features")
def meta_features(spark, folder):
    return _expanded(spark, folder, {
        "gap": F.abs(F.col("pred_e") - F.col("pred_a")), "spread": row_std(M), "conf": F.abs(F.col("pred_e") - 55.0),
        "gate": (F.col("pred_e") > 80).cast("double"), "cap": F.col("p_cap"), "year": F.col("cohort_year") - 1995.0})


@query("en15_two_layer_stack")
def two_layer(spark, folder):
    df, m = stacked(spark, folder)
    first = df.select("row_id", "folds", Y, W, bl.meta_oof(m, ["pred_a", "pred_b"], "ridge_pos").alias("f1"), bl.meta_oof(m, ["pred_c", "pred_e"], "ridge_pos").alias("f2"))
    second = gr.cell_moments(first, ["f1", "f2"], Y, W)
    return first.select("row_id", Y, bl.meta_oof(second, ["f1", "f2"], "ridge_pos").alias("pred"))


@query("mt16_leave_one_out")
def leave_one_out(spark, folder):
    df, m = stacked(spark, folder)
    return spark.createDataFrame(sorted(bl.leave_one_out(df, m, M, Y, W).items()), "member string, loss_without double")
