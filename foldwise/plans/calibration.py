"""Calibration, gate and post-processing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rowwise import clip, row_std, squared_error
from ..functions.solvers import ridge_from_moments
from ..operators import calibrate as ca
from ..operators import gram as gr
from ..operators import isotonic as iso
from ..operators.ranks import bin_of, quantile_edges, with_ranks
from ..session import pin
from ..sources import frame as fr
from .blends import stack
from .profiles import rounded
from .registry import query
from .sqlbase import bin_edges, bin_number, with_blocks

Y, W, P = fr.TARGET, "w", "pred_b"
CENTRE = 55.0


def nested_sql(cands: dict[str, str], base: str = "scored") -> dict[str, str]:
    """Brute blocks of a nested parameter grid: candidate losses, picks, averaged prediction."""
    arms = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(cands.values()))
    return {
        "cand": f"SELECT row_id, score, w, k, least(greatest(CASE k {arms} END, 0), 100) AS p FROM {base}, (SELECT unnest(range({len(cands)})) AS k)",
        "cellloss": "SELECT repeat, fold, k, sum(w * (score - p) * (score - p)) AS l FROM cand JOIN folds USING (row_id) GROUP BY ALL",
        "pick": "SELECT a.repeat, a.fold, arg_min(k, (l, k)) AS k FROM (SELECT c.repeat, c.fold, o.k, sum(o.l) AS l FROM (SELECT DISTINCT repeat, fold FROM folds) c JOIN cellloss o ON o.repeat = c.repeat AND o.fold <> c.fold GROUP BY ALL) a GROUP BY ALL",
        "meta": "SELECT row_id, least(greatest(avg(p), 0), 100) AS post FROM folds JOIN pick USING (repeat, fold) JOIN cand USING (row_id, k) GROUP BY row_id",
    }


def nested(spark, folder, make):
    df = stack(spark, folder)
    return rounded(ca.nested_grid(df, make, Y, W)[0].select("row_id", "post"), 7)


META = "SELECT row_id, round(post, 7) AS post FROM meta"


#: The max-min form: the best lower bound over all starts of the least mean over all ends.
ISOTONIC = {
    "pts": f"SELECT *, sum(n) OVER (ORDER BY x) AS cn, sum(s) OVER (ORDER BY x) AS cs FROM (SELECT {P} AS x, count(*) AS n, sum(score) AS s FROM scored GROUP BY 1)",
    "ends": "SELECT b.x, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.x ORDER BY b.x DESC) AS lo FROM pts a JOIN pts b ON b.x >= a.x",
    "iso": "SELECT x, max(lo) AS v FROM ends GROUP BY x",
}


@query("ca01_isotonic_global", with_blocks(f"SELECT row_id, round(v, 7) AS post FROM scored JOIN iso ON {P} = x", "scored", extra=ISOTONIC))
def isotonic_global(spark, folder):
    """One exact monotone map of all rows."""
    df = stack(spark, folder)
    scored = iso.values(df, iso.fit(df, P, Y, frozen=True), P, "iso")
    return rounded(scored.select("row_id", iso.post("iso").alias("post")), 7)


@query("ca02_isotonic_nested")
def isotonic_nested(spark, folder):
    df = stack(spark, folder)
    return iso.values(df, iso.fit(df, P, Y), P, "iso").select("row_id", iso.post("iso").alias("post"))


@query("ca03_isotonic_per_year")
def isotonic_per_year(spark, folder):
    df = stack(spark, folder)
    scored = iso.values(df, iso.fit(df, P, Y), P, "every")
    scored = iso.values(scored, iso.fit(df, P, Y, ["cohort_year"]), P, "own")
    return scored.select("row_id", "cohort_year", iso.post("every", "own", ca.MIN_CELL).alias("post"))


@query("ca04_isotonic_band_grid")
def isotonic_band_grid(spark, folder):
    df = stack(spark, folder)
    overall = iso.values(df, iso.fit(df, P, Y), P, "every").select("row_id", "every")
    tags = {}
    for bands in (2, 4):
        edges = quantile_edges(df, P, bands, (0.0, 100.0))
        for mode in ("all", "late"):
            late = F.lit(0) if mode == "all" else (F.col("cohort_year") >= fr.LATE_YEAR).cast("int")
            tags[bands, mode] = bin_of(P, edges) * 2 + late
    # Every tagging is one more group level of a single fit.
    tagged = df.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), c.alias("g")) for i, c in enumerate(tags.values())])).alias("tag"))
    tagged = tagged.select("*", F.concat_ws("|", "tag.t", "tag.g").alias("g")).withColumn("id", F.concat_ws("|", "row_id", "tag.t"))
    own = iso.values(tagged, iso.fit(tagged, P, Y, ["g"]), P, "own", "id").join(overall, "row_id")
    sizes = (150, 600)
    loss = [(F.sum(F.col(W) * squared_error(Y, iso.post("every", "own", m))) / F.sum(W)).alias(f"s{m}") for m in sizes]
    names = F.array(*[F.struct(F.lit(b).alias("bands"), F.lit(m).alias("year_mode")) for b, m in tags])
    return own.groupBy("tag.t").agg(*loss).select(names[F.col("t")].alias("k"), F.explode(F.array(*[F.struct(F.lit(m).alias("min_rows"), F.col(f"s{m}").alias("nested_rw")) for m in sizes])).alias("v")).select(
        "k.bands", "k.year_mode", "v.min_rows", "v.nested_rw")


SD = "round(list_stddev_samp([pred_a, pred_b, pred_c, pred_e]), 6)"


@query("ca05_bin_pair_shrink", with_blocks(
    "SELECT row_id, round(least(greatest(avg(least(greatest(pred_b + CASE WHEN n >= 30 THEN s / (n + 50.0) ELSE 0 END, 0), 100)), 0), 100), 6) AS post FROM "
    "(SELECT v.row_id, v.pred_b, t.n, coalesce(t.s, 0) AS s FROM (SELECT * FROM binned JOIN folds USING (row_id)) v LEFT JOIN "
    "(SELECT c.repeat, c.fold, kp, ks, count(*) AS n, sum(score - pred_b) AS s FROM (SELECT DISTINCT repeat, fold FROM folds) c JOIN folds f ON f.repeat = c.repeat AND f.fold <> c.fold JOIN binned USING (row_id) GROUP BY ALL) t "
    "ON t.repeat = v.repeat AND t.fold = v.fold AND t.kp = v.kp AND t.ks = v.ks) GROUP BY row_id", "scored", "folds", extra={
        "sds": f"SELECT *, {SD} AS sd FROM scored", "ep": bin_edges("sds", "pred_b", 8), "es": bin_edges("sds", "sd", 3),
        "binned": f"SELECT row_id, score, pred_b, {bin_number('pred_b', 'ep.edges')} AS kp, {bin_number('sd', 'es.edges')} AS ks FROM sds, ep, es"}))
def bin_pair_shrink(spark, folder):
    df = pin(stack(spark, folder).withColumn("sd", F.round(row_std(["pred_a", "pred_b", "pred_c", "pred_e"]), 6)))
    bins = [bin_of(P, quantile_edges(df, P, 8, (0.0, 100.0))), bin_of("sd", quantile_edges(df, "sd", 3, (0.0, 100.0)))]
    return rounded(ca.bin_shrink(df, bins, P, Y, 50.0, 30).select("row_id", "post"))


BIN_GRID = {f"{k}x{n},alpha={a:g}": (k, n, a) for k, n in ((8, 3), (12, 4)) for a in (20.0, 50.0, 150.0)}


@query("ca05b_bin_pair_choice")
def bin_pair_choice(spark, folder):
    """(bins, alpha) chosen per cell by what each grid point is worth on the other cells' held-out rows."""
    df = pin(stack(spark, folder).withColumn("sd", F.round(row_std(["pred_a", "pred_b", "pred_c", "pred_e"]), 6)))
    wide = df
    for i, (k, n, a) in enumerate(BIN_GRID.values()):
        bins = [bin_of(P, quantile_edges(df, P, k, (0.0, 100.0))), bin_of("sd", quantile_edges(df, "sd", n, (0.0, 100.0)))]
        wide = wide.join(ca.bin_shrink(df, bins, P, Y, a, 30, f"g{i}").select("row_id", f"g{i}"), "row_id")
    cands = {"none": F.col(P), **{name: F.col(f"g{i}") for i, name in enumerate(BIN_GRID)}}
    post, choice = ca.nested_grid(pin(wide), cands, Y, W)
    s = post.agg(*[(F.sum(F.col(W) * squared_error(Y, c)) / F.sum(W)).alias(c) for c in (P, "post")]).first()
    return spark.createDataFrame([(r, f, n, float(s[P]), float(s["post"])) for (r, f), n in sorted(choice.items())], "repeat int, fold int, chosen string, rw_before double, nested_rw double")


def fitted_members(df):
    """Corrections fitted by least squares in every cell: a straight line, a hinge spline, and shrunken bin residuals."""
    p = F.col(P)
    hinges = {f"h{k:g}": F.greatest(p - k, F.lit(0.0)) for k in (30.0, 50.0, 70.0, 85.0)}
    wide = pin(df.select("*", *[c.alias(n) for n, c in hinges.items()]))
    out = {}
    for name, cols, alpha in (("affine_fit", [P], 0.0), ("spline_fit", [P, *hinges], 1.0)):
        moments = gr.cell_moments(wide, cols, Y, W)
        out[name] = gr.held_out_column(cols, gr.fit_cells(moments, lambda t, a=alpha: ridge_from_moments(t, a)))
    bins = [bin_of(P, quantile_edges(df, P, 12, (0.0, 100.0)))]
    return ca.bin_shrink(wide, bins, P, Y, 50.0, 30, "bin_shrink"), {**out, "bin_shrink": F.col("bin_shrink")}


@query("ca06_postprocess_zoo")
def postprocess_zoo(spark, folder):
    df = stack(spark, folder)
    out = []
    for name, cands in ca.zoo(P).items():
        post, choice = ca.nested_grid(df, cands, Y, W)
        s = post.agg((F.sum(F.col(W) * squared_error(Y, "post")) / F.sum(W)).alias("s")).first()["s"]
        out.append((name, len(cands), sorted(set(choice.values())), float(s)))
    wide, members = fitted_members(df)
    for name, s in gr.weighted_score(wide, members, Y, W).items():
        out.append((name, 1, [name], float(s)))
    return spark.createDataFrame(out, "family string, n_candidates int, chosen array<string>, nested_rw double")


@query("ca07_cap_pull", with_blocks(META, "scored", "folds", extra=nested_sql(
    {str(a): f"pred_b + CAST({a} AS DOUBLE) * p_cap * (100.0 - pred_b)" for a in ca.ALPHA_GRID})))
def cap_pull(spark, folder):
    return nested(spark, folder, ca.cap_pull(P, "p_cap"))


def gate_sql(thr: str, a: str) -> str:
    return f"least(greatest(CASE WHEN abs(pred_e - {CENTRE}) >= {thr} AND pred_e > {CENTRE} THEN pred_b + {a} * (pred_e - pred_b) ELSE pred_b END, 0), 100)"


@query("ca08_confidence_gate", with_blocks(f"SELECT row_id, round({gate_sql('25.0', '0.3::DOUBLE')}, 6) AS post FROM scored", "scored"))
def confidence_gate(spark, folder):
    return rounded(stack(spark, folder).select("row_id", ca.gate(P, "pred_e", 25.0, 0.3, CENTRE).alias("post")))


QS, AS = ca.Q_GRID, ca.A_GRID


@query("ca09_nested_gate", with_blocks(
    "SELECT row_id, round(least(greatest(avg(p), 0), 100), 6) AS post FROM (SELECT v.row_id, " + gate_sql("k.thr", "k.a") +
    " AS p FROM (SELECT * FROM scored JOIN folds USING (row_id)) v JOIN best k ON k.repeat = v.repeat AND k.fold = v.fold) GROUP BY row_id", "scored", "folds", extra={
        "fit": "SELECT c.repeat AS r, c.fold AS f, s.* FROM (SELECT DISTINCT repeat, fold FROM folds) c JOIN folds o ON o.repeat = c.repeat AND o.fold <> c.fold JOIN scored s ON s.row_id = o.row_id",
        "thr": " UNION ALL ".join(f"SELECT r, f, {i} AS qi, quantile_cont(pred_e - {CENTRE}, {q}) AS thr FROM fit WHERE pred_e > {CENTRE} GROUP BY ALL" for i, q in enumerate(QS)),
        "losses": "SELECT fit.r, fit.f, qi, thr, a, sum(w * pow(score - " + gate_sql("thr", "a") + ", 2)) AS l FROM fit JOIN thr ON thr.r = fit.r AND thr.f = fit.f, (SELECT unnest([" + ", ".join(f"{a}::DOUBLE" for a in AS) + "]) AS a) GROUP BY ALL",
        "best": "SELECT r AS repeat, f AS fold, thr, a FROM losses QUALIFY row_number() OVER (PARTITION BY r, f ORDER BY round(l, 3), qi, a) = 1"}))
def nested_gate(spark, folder):
    df, _ = ca.nested_gate(stack(spark, folder), P, "pred_e", Y, W, CENTRE)
    return rounded(df.select("row_id", "post"))


@query("ca10_gate_variants")
def gate_variants(spark, folder):
    df = stack(spark, folder)
    thr = [float(x) for x in quantile_edges(df.select(F.abs(F.col("pred_e") - CENTRE).alias("c")), "c", 4, (0.0, 100.0))]
    grids = {
        "two_way": {f"{t:g}|{u}|{d}": ca.two_way_gate(P, "pred_e", t, u, d, CENTRE) for t in thr for u in (0.0, 0.3) for d in (0.0, 0.2)},
        "sigmoid": {f"{t:g}|{a}": ca.sigmoid_gate(P, "pred_e", t, a, CENTRE) for t in thr for a in (0.0, 0.2, 0.4)},
        "band": {f"{lo}|{a}": ca.band_gate(P, "pred_e", lo, lo + 20.0, a) for lo in (20.0, 40.0, 60.0, 80.0) for a in (0.0, 0.3)},
        "multi_model": {f"{m}|{a}": ca.gate(P, m, thr[-1], a, CENTRE) for m in ("pred_a", "pred_e") for a in (0.0, 0.3, 0.5)},
    }
    out = []
    for name, cands in grids.items():
        post, choice = ca.nested_grid(df, cands, Y, W)
        s = post.agg((F.sum(F.col(W) * squared_error(Y, "post")) / F.sum(W)).alias("s")).first()["s"]
        out.append((name, sorted(set(choice.values())), float(s)))
    return spark.createDataFrame(out, "variant string, chosen array<string>, nested_rw double")


@query("ca11_postprocess_chain")
def postprocess_chain(spark, folder):
    df = stack(spark, folder)
    stages = {"cap": lambda c: ca.cap_pull(c, "p_cap"), "gate": lambda c: {f"{a}": ca.gate(c, "pred_e", 20.0, a, CENTRE) for a in ca.A_GRID},
              "affine": lambda c: ca.zoo(c)["affine"], "gamma": lambda c: ca.zoo(c)["gamma"]}
    _, kept = ca.chain(df, stages, P, Y, W)
    base = df.agg((F.sum(F.col(W) * squared_error(Y, P)) / F.sum(W)).alias("s")).first()["s"]
    return spark.createDataFrame([("base", float(base)), *kept], "stage string, nested_rw double")


@query("ca12_censored_expectation")
def censored_expectation(spark, folder):
    """Spread of |residual| fitted out of fold on the prediction, then E[clip(N(mu, c*sigma))]."""
    from ..functions.solvers import ridge_from_moments

    df = stack(spark, folder).withColumn("abs_res", F.abs(F.col(Y) - F.col(P))).withColumn("p2", F.col(P) * F.col(P) / 100.0)
    m = gr.cell_moments(df, [P, "p2"], "abs_res")
    sigma = gr.held_out_column([P, "p2"], gr.fit_cells(m, lambda t: ridge_from_moments(t, 1.0)))
    spread = pin(df.withColumn("sigma", F.greatest(sigma * 1.2533, F.lit(0.1))))
    for i, c in enumerate((0.5, 1.0, 1.5)):
        spread = spread.withColumn(f"e{i}", ca.clipped_normal_mean(P, "sigma", c))
    spread = pin(spread)
    post, _ = ca.nested_grid(spread, {"none": F.col(P), **{f"c{i}": F.col(f"e{i}") for i in range(3)}}, Y, W)
    return post.select("row_id", "sigma", "post")


LOW = "round(least(greatest((50.0 - pred_c) / 40.0, 0.0), 1.0), 9)"
BETA = (0.0, 2.0, 4.0, 8.0, 12.0)


def p_low():
    return F.round(clip((50.0 - F.col("pred_c")) / 40.0, 0.0, 1.0), 9)


@query("ca13_low_tail_pull", with_blocks(META, "scored", "folds", extra=nested_sql({str(b): f"pred_b - CAST({b} AS DOUBLE) * {LOW}" for b in BETA})))
def low_tail(spark, folder):
    df = stack(spark, folder).withColumn("p_low", p_low())
    return rounded(ca.nested_grid(df, ca.low_pull(P, "p_low", BETA), Y, W)[0].select("row_id", "post"), 7)


@query("ca14_risk_gate")
def risk_gate(spark, folder):
    """Rows with a high risk score move toward the mean, a strong model or the median; fitted per cell."""
    df = pin(stack(spark, folder).withColumn("sd", row_std(["pred_a", "pred_b", "pred_c"])))
    toward = {"strong": F.col("pred_a"), "median": F.array_sort(F.array("pred_a", "pred_b", "pred_c"))[1]}
    post, _ = ca.risk_gate(df, [P, "sd", "p_cap"], P, Y, W, toward)
    return post.groupBy("flagged").agg(
        F.count("*").alias("n"), F.avg(squared_error(Y, P)).alias("mse_before"), F.avg(squared_error(Y, "post")).alias("mse_after"))


CONF_T, SHRINK = (10.0, 20.0, 30.0), (0.0, 0.1, 0.25)


@query("ca15_confidence_shrink", with_blocks(
    " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, {s}::DOUBLE AS shrink, count(*) FILTER (WHERE abs(pred_e - pred_b) >= {t}) AS n_moved, "
                       f"round(sum(w * pow(score - CASE WHEN abs(pred_e - pred_b) >= {t} THEN pred_b + {s}::DOUBLE * ({CENTRE} - pred_b) ELSE pred_b END, 2)) / sum(w), 6) AS rw_mse FROM scored" for t in CONF_T for s in SHRINK), "scored"))
def confidence_shrink(spark, folder):
    from ..operators.profile import melt

    df = stack(spark, folder)
    rows = {}
    for t in CONF_T:
        far = F.abs(F.col("pred_e") - F.col(P)) >= t
        for s in SHRINK:
            moved = F.when(far, F.col(P) + s * (CENTRE - F.col(P))).otherwise(F.col(P))
            rows[f"{t}|{s}"] = F.struct(F.sum(far.cast("long")).alias("n"), (F.sum(F.col(W) * squared_error(Y, moved)) / F.sum(W)).alias("m"))
    part = F.split("rule", r"\|")
    return melt(df, rows, "rule").select(part[0].cast("double").alias("threshold"), part[1].cast("double").alias("shrink"),
                                         F.col("value.n").alias("n_moved"), F.round("value.m", 6).alias("rw_mse"))


@query("ca16_global_multiplier", with_blocks(
    "SELECT round(m, 6) AS multiplier, round(sum(w * pow(score - pred_b, 2)) / sum(w), 6) AS rw_before, round(sum(w * pow(score - least(m * pred_b, 100), 2)) / sum(w), 6) AS rw_after FROM scored, "
    "(SELECT sum(w * score * pred_b) / sum(w * pred_b * pred_b) AS m FROM scored) GROUP BY m", "scored"))
def global_multiplier(spark, folder):
    df = stack(spark, folder)
    m = df.agg(F.sum(F.col(W) * F.col(Y) * F.col(P)) / F.sum(F.col(W) * F.col(P) * F.col(P))).scalar()
    moved = df.select(Y, W, P, m.alias("m"))
    return rounded(moved.agg(
        F.first("m").alias("multiplier"), (F.sum(F.col(W) * squared_error(Y, P)) / F.sum(W)).alias("rw_before"),
        (F.sum(F.col(W) * squared_error(Y, clip(F.col("m") * F.col(P)))) / F.sum(W)).alias("rw_after")))


@query("ca16b_rank_inputs", with_blocks(
    "SELECT row_id, " + ", ".join(f"round(percent_rank() OVER (ORDER BY {m}), 6) AS {m}_rank" for m in fr.MODELS[:3]) + " FROM scored", "scored"))
def rank_inputs(spark, folder):
    df = stack(spark, folder).select("row_id", *fr.MODELS[:3])
    ranked = with_ranks(df, {f"{m}_rank": (m, (0.0, 100.0)) for m in fr.MODELS[:3]}, percent=True)
    return rounded(ranked.select("row_id", *[f"{m}_rank" for m in fr.MODELS[:3]]))
