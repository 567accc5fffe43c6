from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.functions import solvers as sv
from foldwise.functions.textexpr import char_ngrams, fold_case, fold_case_py, word_ngrams, words
from foldwise.operators import blend as bl
from foldwise.operators import calibrate as ca
from foldwise.operators import folds as fo
from foldwise.operators import gram as gr
from foldwise.operators import isotonic as iso
from foldwise.operators import metrics as mt
from foldwise.operators import oof
from foldwise.operators import text as te
from foldwise.operators import textridge as tr
from foldwise.operators.censored import fit_censored
from foldwise.operators.neighbours import exact_knn
from foldwise.session import fresh_path
from foldwise.sources import store as st


@pytest.fixture(scope="module")
def stackable(spark):
    """Known convex weights: 0.7 a + 0.3 b; model c is pure noise."""
    rng = np.random.default_rng(5)
    n = 600
    a, b, c = rng.uniform(20, 80, n), rng.uniform(20, 80, n), rng.uniform(0, 100, n)
    pdf = pd.DataFrame({"row_id": np.arange(n), "a": a, "b": b, "c": c, "y": np.clip(0.7 * a + 0.3 * b + rng.normal(0, 1, n), 0, 100), "w": rng.uniform(0.5, 2, n)})
    df = spark.createDataFrame(pdf)
    folds = fo.stratified_folds(df, "y")
    return pdf, gr.with_fold_array(df, folds).cache(), folds.toPandas()


def test_nested_weights_equal_refit_per_cell(stackable):
    pdf, df, folds = stackable
    m = gr.cell_moments(df, ["a", "b", "c"], "y", "w")
    got = df.select("row_id", bl.meta_oof(m, ["a", "b", "c"], "ridge_pos").alias("p")).toPandas().set_index("row_id").p
    want = np.zeros(len(pdf))
    for r in range(3):
        for f in range(5):
            held = folds[(folds.repeat == r) & (folds.fold == f)].row_id.to_numpy()
            tr_ = pdf.drop(index=held)
            z = np.column_stack([np.ones(len(tr_)), tr_[["a", "b", "c"]], tr_.y])
            coef, inter = sv.ridge_pos_from_moments(z.T @ (z * tr_.w.to_numpy()[:, None]))
            want[held] += pdf.loc[held, ["a", "b", "c"]].to_numpy() @ coef + inter
    assert np.allclose(got.loc[pdf.row_id], np.clip(want / 3, 0, 100), atol=1e-8)


def test_known_weights_are_recovered(stackable):
    _, df, _ = stackable
    m = gr.cell_moments(df, ["a", "b", "c"], "y", "w")
    for method in ("nnls", "ridge_pos"):
        coef, _ = bl.METHODS[method](m.total())
        assert np.allclose(coef[:2], [0.7, 0.3], atol=0.02) and coef[2] < 0.02 and (coef >= 0).all()


def test_nonnegative_solver_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(50):
        q = rng.normal(size=(20, 6))
        a, b = q.T @ q, rng.normal(size=6) * 5
        x = sv.nonnegative_quadratic(a, b)
        slope = a @ x - b
        assert (x >= 0).all() and (slope > -1e-7).all() and abs(slope @ x) < 1e-6


def test_student_tail():
    assert sv.student_t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)


def max_min(x, y):
    """The monotone fit at every distinct x, by its max-min formula."""
    xs = np.unique(x)
    n, s = (np.array([(f(x == v)) for v in xs], dtype=float) for f in (np.sum, lambda m: y[m].sum()))
    cn, cs = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(s)])
    mean = lambda i, j: (cs[j + 1] - cs[i]) / (cn[j + 1] - cn[i])
    return xs, np.array([max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))])


@pytest.mark.parametrize("buckets", [1, 13])
def test_isotonic_cells_equal_the_max_min_formula(spark, buckets):
    rng = np.random.default_rng(1)
    n = 240
    pdf = pd.DataFrame({"row_id": np.arange(n), "g": rng.choice(["a", "b", "c"], n, p=[0.6, 0.39, 0.01]), "b": np.round(rng.uniform(-5, 105, n), 1)})
    pdf.loc[:60, "b"] = 42.0  # one value for a quarter of the rows
    pdf["y"] = np.clip(pdf.b, 0, 100) + rng.normal(0, 15, n)
    df = spark.createDataFrame(pdf)
    df = gr.with_fold_array(df, fo.stratified_folds(df, "y")).cache()
    every = iso.values(df, iso.fit(df, "b", "y", buckets=buckets), "b", "every")
    own = iso.values(every, iso.fit(df, "b", "y", ["g"], buckets=buckets), "b", "own")
    got = own.select("*", iso.post("every", "own", 40).alias("post")).toPandas().sort_values("row_id")
    x, y, g = np.clip(got.b.to_numpy(), 0, 100), got.y.to_numpy(), got.g.to_numpy()
    folds = np.vstack(got.folds.to_numpy())
    for k in range(0, n, 11):
        parts = []
        for r in range(3):
            train = folds[:, r] != folds[k, r]
            mine = train & (g == g[k])
            xs, v = max_min(x[mine], y[mine]) if mine.sum() >= 40 else max_min(x[train], y[train])
            parts.append(np.clip(np.interp(x[k], xs, v), 0, 100))
        assert got.post.iloc[k] == pytest.approx(np.mean(parts), abs=1e-9)


def test_isotonic_of_all_rows_is_exact_at_any_precision(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"row_id": np.arange(300), "b": rng.uniform(0, 1e-4, 300)})
    pdf["y"] = 1e5 * pdf.b + rng.normal(0, 5, 300)
    df = spark.createDataFrame(pdf)
    got = iso.values(df, iso.fit(df, "b", "y", frozen=True, buckets=9), "b", "v").select("row_id", "b", F.col("v")[0]["v"].alias("v"), F.col("v")[0]["n"].alias("n")).toPandas().sort_values("row_id")
    xs, v = max_min(pdf.b.to_numpy(), pdf.y.to_numpy())
    assert np.allclose(got.v, np.interp(pdf.b, xs, v)) and (got.n == 300).all()


def test_gate_prefers_the_informative_model(spark):
    rng = np.random.default_rng(8)
    n = 900
    y = rng.uniform(30, 100, n)
    pdf = pd.DataFrame({"row_id": np.arange(n), "y": y, "w": 1.0, "p": 65 + 0.3 * (y - 65) + rng.normal(0, 3, n), "good": y + rng.normal(0, 2, n)})
    pdf["shuffled"] = rng.permutation(pdf.good)
    df = spark.createDataFrame(pdf)
    df = gr.with_fold_array(df, fo.stratified_folds(df, "y")).cache()
    _, good = ca.nested_gate(df, "p", "good", "y", "w", 60.0)
    _, bad = ca.nested_gate(df, "p", "shuffled", "y", "w", 60.0)
    assert all(a > 0 for _, a in good.values()) and all(a == 0 for _, a in bad.values())


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    x[:100] = x[0] + rng.normal(0, 1e-3, (100, 5))  # a dense third
    pdf = pd.DataFrame({"id": np.arange(300), "vec": list(x), "y": rng.random(300), "g": np.arange(300) % 5})
    df = spark.createDataFrame(pdf, "id long, vec array<double>, y double, g int")
    got = exact_knn(df.select("id", "vec", "g"), df, 7, n_pivots=6).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d[(pdf.g.to_numpy()[:, None] == pdf.g.to_numpy()[None, :])] = np.inf
    want = np.sort(d, axis=1)[:, :7]
    assert np.allclose(got.sort_values(["id", "rank"]).dist.to_numpy().reshape(300, 7), want, atol=1e-6)


def test_neighbours_leave_a_cell_only_within_the_bound(spark, monkeypatch):
    """Spread queries meet every cell, but no more than a few rows of each; ties go by the id, groups and small tables hold."""
    from foldwise.operators import neighbours as nb

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 3)) * np.array([1.0, 1.0, 40.0]), 1)
    x[200:300] = x[:100]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "vec": list(x), "y": rng.random(400), "g": 0}), "id long, vec array<double>, y double, g int")
    merged = []
    pin = nb.pin
    monkeypatch.setattr(nb, "pin", lambda d: merged.append(pin(d)) or merged[-1])
    got = exact_knn(df.select("id", "vec", F.lit(-1).alias("g")), df, 4, n_pivots=12).toPandas().sort_values(["id", "rank"])
    d2 = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)
    want = np.sort(np.sqrt(d2), axis=1)[:, :4]
    assert np.allclose(got.dist.to_numpy().reshape(400, 4), want, atol=1e-5)
    visits = [t for t in merged if "cell" in t.columns and "bound" in t.columns]
    assert visits and sum(t.count() for t in visits) < 0.5 * 400 * 12
    few = df.filter("id < 3")
    assert exact_knn(df.select("id", "vec", F.lit(-1).alias("g")), few, 4).groupBy("id").count().filter("count = 3").count() == 400


def test_references_with_gaps_hide_no_others_of_their_cell(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "vec": list(x), "y": 0.0, "g": 0}), "id long, vec array<double>, y double, g int")
    gap = df.filter("id < 20").select((F.col("id") + 1000).alias("id"), F.array(F.col("vec")[0], F.lit(float("nan")), F.col("vec")[2]).alias("vec"), "y", "g")
    got = exact_knn(df.select("id", "vec", F.lit(-1).alias("g")), df.unionByName(gap), 4, n_pivots=8).toPandas().sort_values(["id", "rank"])
    want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, :4]
    assert np.allclose(got.dist.to_numpy().reshape(300, 4), want, atol=1e-6)


def test_screened_neighbours_equal_full_distances():
    """Far outliers, copies, groups and bounds: what short floats screen is what full distances give, ties by place."""
    from foldwise.operators import neighbours as nb

    rng = np.random.default_rng(6)
    ref = np.vstack([rng.normal(size=(3000, 6)), np.full((1, 6), 1e5), rng.normal(size=(2000, 6)) * 1e-3 + 40.0])
    ref[1000:1500] = ref[:500]
    q, rg = ref[::7] + rng.choice([0.0, 0.01], (len(ref[::7]), 1)), rng.integers(0, 3, len(ref))
    qg = np.where(np.arange(len(q)) % 2, -1, rng.integers(0, 3, len(q)))
    most = np.where(np.arange(len(q)) % 5, np.inf, 0.25)
    row, col, d2 = nb._nearest_of(q, qg, most, ref, rg, 4)
    for i in range(len(q)):
        d = ((ref - q[i]) ** 2).sum(axis=1)
        d[(d > most[i]) | ((rg == qg[i]) & (qg[i] >= 0))] = np.inf
        want = [j for j in np.lexsort((np.arange(len(d)), d))[:4] if d[j] < np.inf]
        assert np.allclose(d2[row == i], d[want], rtol=1e-9, atol=1e-18)
        assert list(col[row == i]) == want or len(np.unique(d[want])) < len(want)


def test_censored_regression_recovers_the_latent_line(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 2))
    latent = 85 + 12 * x[:, 0] - 5 * x[:, 1] + rng.normal(0, 8, 3000)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": np.minimum(latent, 100.0)}))
    beta, b0, sigma, _ = fit_censored(df, ["a", "b"], "y")
    assert np.allclose([*beta, b0, sigma], [12, -5, 85, 8], atol=0.7)


def test_held_out_tree_predictions_ignore_their_own_targets(spark, folder):
    """Poison test on the out-of-fold runner."""
    from foldwise.plans.models import prepared

    data = prepared(spark, folder)
    bad = data.withColumn("y", F.when(F.col("folds")[0] == 3, 0.0).otherwise(F.col("y")))
    fit = oof.gbt(maxIter=2, maxDepth=2)
    pick = lambda d: oof.run_oof(d, fit, 1).filter(F.col("folds")[0] == 3).select("row_id", "pred").orderBy("row_id").toPandas().pred
    assert np.allclose(pick(data), pick(bad))


def test_trees_beat_the_mean(spark, folder):
    from foldwise.plans.models import prepared

    q = oof.quality(oof.run_oof(prepared(spark, folder), oof.gbt(maxIter=5), 1), "gbt").toPandas()
    assert (q.mse < 0.6 * q.mse_of_mean).all()


# ---- text ------------------------------------------------------------------------


def test_case_folding(spark):
    row = spark.createDataFrame([("I", "İ", "GÜÇLÜ")], "a string, b string, c string").select(fold_case("a"), fold_case("b"), fold_case("c")).first()
    assert list(row) == ["ı", "i", "güçlü"] and fold_case_py("IİĞ") == "ıiğ"


def test_handcrafted_counts_equal_plain_counting(spark):
    from foldwise.functions import lexicon

    words = {k: v for k, v in vars(lexicon).items() if k.isupper() and isinstance(v, (list, tuple))}
    some = [w for group in words.values() for w in group]
    texts = [(0, None), (1, ""), (2, "xyz"), (3, " ".join(some)), (4, ". ".join(reversed(some)) + "!"), (5, some[0] * 3)]
    rows = {r.row_id: r for r in te.handcrafted(spark.createDataFrame(texts, "row_id int, t string"), "t").collect()}
    counts = [c for c in rows[3].asDict() if c.startswith("n_")]
    assert len(rows) == len(texts) and counts
    assert all((rows[0][c] or 0) == (rows[1][c] or 0) for c in counts)
    assert all(rows[3][c] >= rows[2][c] for c in counts)


def test_ngrams(spark):
    df = spark.createDataFrame([("bir iki x uc",)], "t string")
    assert df.select(words("t", ["bir"]).alias("w")).select(word_ngrams("w", 1, 3)).first()[0] == ["iki", "uc", "iki uc"]
    assert df.limit(1).select(char_ngrams(F.lit("ab c"), 3, 5)).first()[0] == [" ab", "ab ", " ab ", " c "]


def closed_form(tf, y, train, alpha):
    """Ridge on unit TF-IDF rows: predictions of all rows, and the intercept."""
    sub = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0)
    x = sub * (np.log((1 + train.sum()) / (1 + (tf[train] > 0).sum(0))) + 1)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    yt = y[train]
    xc = x[train] - x[train].mean(0)
    coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (yt - yt.mean()))
    return (x - x[train].mean(0)) @ coef + yt.mean()


def small_texts(spark, n, n_test=0):
    rng = np.random.default_rng(9)
    vocab = ["alfa", "beta", "gama", "delta", "epsi", "zeta"]
    docs = [" ".join(rng.choice(vocab, 8)) for _ in range(n + n_test)]
    docs[3] = ""
    y = np.array([min(100.0, round(20.0 + 8.0 * d.count("alfa") + 3.0 * d.count("beta") + float(rng.random()), 2)) for d in docs])
    rows = [(i, "train" if i < n else "test", t, float(v) if i < n else None) for i, (t, v) in enumerate(zip(docs, y))]
    df = spark.createDataFrame(rows, "row_id long, split string, text string, y double")
    tf = np.array([[d.split().count(v) for v in vocab] for d in docs], dtype=float)
    return df, tf, y


def test_text_ridge_equals_closed_form(spark):
    df, tf, y = small_texts(spark, 120)
    folds = fo.stratified_folds(df, "y", seeds=(42,))
    space = te.TermSpace("w", "word", 1, 1, 1, 100)
    cells = tr.text_cells(df, folds, "text", "y", [space], nested=False)
    fits = tr.fit_text(cells, (2.0, 0.5))
    assert fits.residual.max() < 1e-8 and len(tr.residuals(fits, cells, (2.0, 0.5))) == 10
    got = tr.score_text(cells, fits).toPandas().set_index("row_id").preds
    f = folds.toPandas().set_index("row_id").fold.loc[range(120)].to_numpy()
    for j, alpha in enumerate((2.0, 0.5)):
        want = np.zeros(120)
        for k in range(5):
            want[f == k] = closed_form(tf, y, f != k, alpha)[f == k]
        assert np.allclose([got[i][j] for i in range(120)], np.clip(want, 0, 100), atol=1e-6)


def test_nested_text_ridge_equals_closed_form(spark):
    df, tf, y = small_texts(spark, 90, 20)
    train = df.filter("split = 'train'")
    folds = fo.stratified_folds(train, "y", seeds=(42, 7))
    space = te.TermSpace("w", "word", 1, 1, 1, 100)
    got = tr.nested_text_ridge(df, folds, "text", "y", [space]).toPandas().set_index("row_id").pred
    held = folds.withColumn("inner", fo.inner_split("row_id", 42, F.col("repeat"), 5)).toPandas()
    at = {(r.row_id, r.repeat): (r.fold, r.inner) for r in held.itertuples()}
    own, every = np.zeros((2, 90)), []
    for r in range(2):
        fold, inner = (np.array([at[i, r][j] for i in range(90)]) for j in (0, 1))
        for f in range(5):
            models = []
            for i in range(5):
                used = np.zeros(110, dtype=bool)
                used[:90] = (fold != f) & (inner != i)
                models.append(closed_form(tf, np.append(y[:90], np.zeros(20)), used, 2.0))
            own[r, fold == f] = np.mean(models, axis=0)[:90][fold == f]
            every += models
    assert np.allclose(got.loc[range(90)], np.clip(own.mean(axis=0), 0, 100), atol=1e-6)
    assert np.allclose(got.loc[range(90, 110)], np.clip(np.mean(every, axis=0)[90:], 0, 100), atol=1e-6)


def test_terms_of_a_text_are_counted_without_a_shuffle_of_terms(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "bb cc bb"), (2, None), (None, "cc cc")], "row_id long, text string")
    counts = te.term_counts(df, "text", te.TermSpace("w", "word", 1, 2))
    got = {(r["row_id"], r["term"]): r["tf"] for r in counts.collect()}
    assert got == {(1, "bb"): 2, (1, "cc"): 1, (1, "bb cc"): 1, (1, "cc bb"): 1, (None, "cc"): 2, (None, "cc cc"): 1}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any("Exchange" in line and "term" in line for line in plan.splitlines())


def test_text_products_are_added_up_in_the_tasks(spark, monkeypatch):
    """However many row blocks there are, a pass sends one sum a task, and chunks of columns give what one chunk gives."""
    from foldwise.operators import sparse as sp

    rng = np.random.default_rng(21)
    vocab = [f"w{i:02d}" for i in range(40)]
    docs = [" ".join(rng.choice(vocab, 15)) for _ in range(200)]
    df = spark.createDataFrame([(i, "train", t, float(i % 50)) for i, t in enumerate(docs)], "row_id long, split string, text string, y double")
    folds = fo.stratified_folds(df, "y", seeds=(42,))
    monkeypatch.setattr(sp, "ENTRIES_BLOCK", 100)
    cells = tr.text_cells(df, folds, "text", "y", [te.TermSpace("w", "word", 1, 1, 1, 100)], nested=False)
    assert cells.matrix.row_blocks > 16
    slots = cells.matrix.slots
    sums = sp.over_rows(cells.matrix, None, lambda b, _: (np.ones((2, slots)), None))
    assert sums.count() <= cells.matrix.term_blocks * spark.sparkContext.defaultParallelism
    whole = tr.score_text(cells, tr.fit_text(cells, (1.0, 2.0))).toPandas().sort_values("row_id")
    monkeypatch.setattr(sp, "CHUNK_BYTES", 8 * cells.matrix.slots * 3)
    split = tr.score_text(cells, tr.fit_text(cells, (1.0, 2.0))).toPandas().sort_values("row_id")
    assert np.allclose(np.vstack(whole.preds), np.vstack(split.preds), atol=1e-5)


def test_nested_text_ridge_does_not_see_held_out_targets(spark):
    df, _, _ = small_texts(spark, 90)
    folds = fo.stratified_folds(df, "y", seeds=(42,))
    poisoned = df.join(folds.filter("fold = 3").select("row_id", F.lit(True).alias("bad")), "row_id", "left").withColumn(
        "y", F.when(F.col("bad"), F.lit(0.0)).otherwise(F.col("y"))).drop("bad")
    space = te.TermSpace("w", "word", 1, 2, 1, 100)
    a, b = (tr.nested_text_ridge(d, folds, "text", "y", [space]).toPandas().set_index("row_id").pred for d in (df, poisoned))
    held = folds.filter("fold = 3").toPandas().row_id
    assert np.allclose(a.loc[held], b.loc[held], atol=1e-6) and not np.allclose(a, b.loc[a.index], atol=1e-3)


def test_vocabulary_of_a_part_is_cut_by_count_then_text(spark):
    rng = np.random.default_rng(4)
    docs = [" ".join(f"t{int(k):02d}" for k in rng.integers(0, 40, 12)) for _ in range(60)]
    df = spark.createDataFrame([(i, "train", t, float(i)) for i, t in enumerate(docs)], "row_id long, split string, text string, y double")
    folds = fo.stratified_folds(df, "y", seeds=(42,))
    cells = tr.text_cells(df, folds, "text", "y", [te.TermSpace("w", "word", 1, 1, 3, 17)], nested=False)
    f = folds.toPandas().set_index("row_id").fold
    known = {r.term: r.idf for r in cells.terms.collect()}
    for j, (_, k, _) in enumerate(cells.parts):
        tf, seen = Counter(), Counter()
        for i, d in enumerate(docs):
            if f[i] != k:
                tf.update(d.split())
                seen.update(set(d.split()))
        best = sorted((t for t in tf if seen[t] >= 3), key=lambda t: (-tf[t], t))[:17]
        got = {t[2:]: v[j] for t, v in known.items() if v[j] > 0}
        assert set(got) == set(best)
        n = sum(f != k)
        assert all(np.isclose(got[t], np.log((1 + n) / (1 + seen[t])) + 1) for t in best)


def test_only_terms_that_a_part_may_choose_are_counted_by_part(spark, monkeypatch):
    """A floor set too high is lowered until every part is full above it; the vocabulary is that of all terms."""
    rng = np.random.default_rng(14)
    docs = [" ".join(f"t{int(k):02d}" for k in rng.zipf(1.4, 14) % 60) for _ in range(70)]
    df = spark.createDataFrame([(i, "train", t, float(i)) for i, t in enumerate(docs)], "row_id long, split string, text string, y double")
    folds = fo.stratified_folds(df, "y", seeds=(42,))
    seen, cut = [], tr._cutoffs
    monkeypatch.setattr(tr, "_cutoffs", lambda terms, *a: (seen.append(terms.count()), cut(terms, *a))[1])
    known = {}
    for share in (0.0, 3.0):
        monkeypatch.setattr(tr, "FIRST_SHARE", share)
        cells = tr.text_cells(df, folds, "text", "y", [te.TermSpace("w", "word", 1, 1, 2, 9)], nested=False)
        known[share] = {r.term: tuple(np.round(r.idf, 12)) for r in cells.terms.collect()}
    assert known[0.0] == known[3.0]
    assert len(seen) > 2 and seen[1] < seen[-1] <= seen[0]


def test_ridge_takes_fewer_steps_after_its_leading_directions(spark, monkeypatch):
    from foldwise.operators import sparse as sp

    rng = np.random.default_rng(15)
    docs = [" ".join(f"k{i % 4}w{int(w)}" for w in rng.integers(0, 60, 25)) for i in range(400)]
    df = spark.createDataFrame([(i, "train", t, float(rng.integers(0, 100))) for i, t in enumerate(docs)], "row_id long, split string, text string, y double")
    cells = tr.text_cells(df, fo.stratified_folds(df, "y", seeds=(42,)), "text", "y", [te.TermSpace("w", "word", 1, 1, 1, 500)], nested=False)
    fast = tr.fit_text(cells, (0.1,))
    monkeypatch.setattr(sp.Leading, "applied", lambda self, r, *a: r.copy())
    plain = tr.fit_text(cells, (0.1,))
    assert fast.residual.max() < 1e-8 and fast.steps < plain.steps
    a, b = (np.concatenate([w.value for w in f.weights]) for f in (fast, plain))
    assert np.allclose(a, b, atol=1e-5 * np.abs(b).max())


def test_text_directions_equal_dense_svd(spark):
    rng = np.random.default_rng(10)
    vocab = [f"w{i:02d}" for i in range(30)]
    docs = [" ".join(rng.choice(vocab, 12, p=np.arange(1, 31) / 465)) for _ in range(80)]
    df = spark.createDataFrame([(i, "train", t, float(i % 50)) for i, t in enumerate(docs)], "row_id long, split string, text string, y double")
    folds = fo.stratified_folds(df, "y", seeds=(42,))
    cells = tr.text_cells(df, folds, "text", "y", [te.TermSpace("w", "word", 1, 1, 1, 100)], nested=False, vectors=500)
    assert cells.matrix.term_blocks > 1
    rows, parts, value = tr.reduced_text(cells, 4, rounds=2, extra=26)
    tf = np.array([[d.split().count(v) for v in vocab] for d in docs], dtype=float)
    sub = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0)
    f = folds.toPandas().set_index("row_id").fold.loc[range(80)].to_numpy()
    z = rows.toPandas().set_index("row_id").z
    for j, (_, k, _) in enumerate(parts):
        used = f != k
        seen = (tf[used] > 0).sum(0)
        x = sub * np.where(seen > 0, np.log((1 + used.sum()) / (1 + seen)) + 1, 0)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s, v = np.linalg.svd(x[used], full_matrices=False)[1:]
        assert np.allclose(value[j], s[:4], rtol=1e-6)
        got, want = np.array([z[i][j] for i in range(80)]), x @ v[:4].T
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-4)


def planted_frame(spark, n=400, n_test=80):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(12)
    x = rng.normal(size=(n + n_test, 3))
    y = np.clip(50 + 12 * x[:, 0] - 6 * x[:, 1] * x[:, 2] + rng.normal(0, 3, len(x)), 0, 100)
    rows = [(i, "train" if i < n else "test", float(y[i]), [float(v) for v in x[i]]) for i in range(len(x))]
    df = spark.createDataFrame(rows, "row_id long, split string, y double, x array<double>")
    folds = fo.stratified_folds(df.filter("split = 'train'"), "y", seeds=(42,))
    return df.join(fo.fold_array(folds), "row_id", "left").select("row_id", "split", "y", "folds", array_to_vector("x").alias("features")).cache()


def poisoned(data, fold):
    return data.withColumn("y", F.when((F.col("split") == "train") & (F.col("folds")[0] == fold), F.lit(0.0)).otherwise(F.col("y"))).cache()


@pytest.mark.parametrize("run", [
    lambda d: oof.two_stage(d, oof.gbt(maxIter=3, maxDepth=2), oof.gbt(maxIter=3, maxDepth=2), lambda y, p: y - p, 1).select("row_id", (F.col("p1") + F.col("p2")).alias("v")),
    lambda d: oof.two_stage(d, oof.gbt(maxIter=2, maxDepth=2), oof.classifier(maxIter=2), lambda y, p: (y > p).cast("double"), 1).select("row_id", F.col("p2").alias("v")),
    lambda d: oof.run_oof(d, oof.pseudo_labelled(d, oof.gbt(weight="_w", maxIter=2, maxDepth=2), (oof.gbt(maxIter=2, maxDepth=2), oof.forest(numTrees=3)), 0.3, 0.5), 1).select("row_id", F.col("pred").alias("v")),
], ids=["residual_chain", "residual_sign", "pseudo_labels"])
def test_two_stage_fits_do_not_see_held_out_targets(spark, run):
    """Poison test: the targets of a fold do not move that fold's own predictions."""
    data = planted_frame(spark)
    a, b = (run(d).toPandas().set_index("row_id").v for d in (data, poisoned(data, 3)))
    held = [r.row_id for r in data.filter("split = 'train' AND folds[0] = 3").select("row_id").collect()]
    others = a.index.difference(held)
    assert np.allclose(a.loc[held], b.loc[held], atol=1e-9) and not np.allclose(a.loc[others], b.loc[others], atol=1e-3)


def test_permutations_move_one_column_and_keep_its_values(spark):
    data = planted_frame(spark).select("row_id", "y", "features")
    plain = {r.row_id: r.features.toArray() for r in data.collect()}
    moved = {}
    for r in oof.permuted(data, (7, 8), 3).collect():
        moved.setdefault((r.seed, r.position), {})[r.row_id] = r.features.toArray()
    assert set(moved) == {(s, p) for s in (7, 8) for p in range(3)}
    for (_, p), rows in moved.items():
        assert rows.keys() == plain.keys()
        rest = [j for j in range(3) if j != p]
        assert all((v[rest] == plain[i][rest]).all() for i, v in rows.items())
        assert sorted(v[p] for v in rows.values()) == sorted(v[p] for v in plain.values())
        assert sum(v[p] != plain[i][p] for i, v in rows.items()) > 0.9 * len(rows)


def test_risk_gate_does_not_see_held_out_targets(spark):
    rng = np.random.default_rng(3)
    n = 500
    y = rng.uniform(20, 100, n)
    pdf = pd.DataFrame({"row_id": np.arange(n), "y": y, "w": 1.0, "s": rng.uniform(1, 10, n)})
    pdf["p"] = np.clip(y + rng.normal(0, pdf.s), 0, 100)
    pdf["m"] = np.clip(y + rng.normal(0, 2, n), 0, 100)
    df = spark.createDataFrame(pdf)
    df = gr.with_fold_array(df, fo.stratified_folds(df, "y")).cache()
    run = lambda d: ca.risk_gate(d, ["p", "s"], "p", "y", "w", {"strong": F.col("m")})
    a, picks = run(df)
    assert all(v.startswith("strong") for v in picks.values())
    hit = df.withColumn("y", F.when(F.col("folds")[0] == 2, F.lit(0.0)).otherwise(F.col("y")))
    one = lambda d: ca.risk_gate(d.withColumn("folds", F.slice("folds", 1, 1)).cache(), ["p", "s"], "p", "y", "w", {"strong": F.col("m")}, n_repeats=1)[0].toPandas().set_index("row_id").post
    x, z = one(df), one(hit)
    held = [r.row_id for r in df.filter("folds[0] = 2").select("row_id").collect()]
    assert np.allclose(x.loc[held], z.loc[held], atol=1e-9)


def test_subset_search_equals_full_enumeration():
    from itertools import combinations

    rng = np.random.default_rng(5)
    for _ in range(5):
        z = rng.normal(size=(60, 10))
        z[:, 0], z[:, -1] = 1.0, z[:, 1:4].sum(axis=1) + rng.normal(size=60)
        m = z.T @ z
        found = bl.best_subsets(m)
        for k in range(1, 9):
            every = []
            for c in combinations(range(8), k):
                keep = [0, *[1 + i for i in c], 9]
                part = m[np.ix_(keep, keep)]
                every.append((bl.squared_loss(part, *sv.nnls_from_moments(part)), c))
            assert found[k][1] == pytest.approx(min(every)[0], rel=1e-9)


def test_bagged_selection_leaves_noise_alone():
    rng = np.random.default_rng(6)
    y = rng.normal(50, 10, 400)
    x = np.column_stack([y + rng.normal(0, 3, 400), y + rng.normal(0, 3, 400), rng.normal(50, 30, 400)])
    z = np.column_stack([np.ones(400), x, y])
    cells = {(0, f): z[f::5].T @ z[f::5] for f in range(5)}
    fitted, whole = bl.bagged_selection(gr.CellMoments(["a", "b", "n"], cells), ["a", "b", "n"], share=0.67)
    assert whole.sum() == pytest.approx(1) and whole[2] < 0.1 and abs(whole[0] - whole[1]) < 0.25
    assert all(w.sum() == pytest.approx(1) for w, _ in fitted.values())


def test_stop_rule_engages_and_uses_the_weights(spark):
    data = planted_frame(spark)
    fitted = oof.fit_all(data, oof.staged_gbt(maxIter=25, maxDepth=4, stepSize=0.9, patience=3), 1)
    ledger = oof.rounds_ledger(fitted)
    assert len(ledger) == 5 and all(tried == 25 for _, _, tried, _, _ in ledger) and any(kept < 25 for *_, kept, _ in ledger)
    scored = oof.score_cells(data, fitted)
    assert scored.filter("pred is null").count() == 0
    train = oof.cell_training(data, 0, 0)
    model = oof.GBTRegressor(featuresCol="features", labelCol="y", maxIter=4, maxDepth=2, seed=1).fit(train)
    rows = train.withColumn("w", 1.0 + F.col("row_id") % 3)
    got = oof.staged_losses(model, rows, "w")
    pdf = rows.toPandas()
    pred = np.zeros(len(pdf))
    for i, (tree, share) in enumerate(zip(model.trees, model.treeWeights)):
        pred += share * np.array([tree.predict(x) for x in pdf.features])
        assert got[i] == pytest.approx(np.average((pdf.y - pred) ** 2, weights=pdf.w))
    assert oof.best_round(np.array([5.0, 4, 3, 3.5, 3.2, 3.1, 2.0]), 3) == 3


def test_null_targets_are_permutations(spark):
    data = planted_frame(spark).filter("split = 'train'").select("row_id", "y", "features")
    rows = oof.null_targets(data, 6).collect()
    y = sorted(r.y for r in rows)
    draws = np.array([r.nulls for r in rows])
    assert draws.shape == (400, 6)
    for j in range(6):
        assert sorted(draws[:, j]) == y and abs(np.corrcoef(draws[:, j], [r.y for r in rows])[0, 1]) < 0.2


def test_repeated_columns_are_dropped_once():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 500))
    x = np.column_stack([a, a + 0.01 * b, b, -a])
    assert oof.correlation_drop(np.cov(x.T), np.array([0.2, 0.5, 0.1, 0.3]), 0.97) == {0: 1, 3: 1}


def test_segment_weights_equal_a_refit_per_segment(spark):
    rng = np.random.default_rng(7)
    n = 900
    y = rng.uniform(10, 90, n)
    pdf = pd.DataFrame({"row_id": np.arange(n), "y": y, "w": rng.uniform(0.5, 2, n), "seg0": rng.choice(["a", "b", "thin", None], n, p=[0.5, 0.4, 0.05, 0.05])})
    pdf["p"], pdf["q"] = y + rng.normal(0, 4, n), y + rng.normal(0, 8, n)
    df = gr.with_fold_array(spark.createDataFrame(pdf), fo.stratified_folds(spark.createDataFrame(pdf), "y")).cache()
    m = gr.cell_moments(df, ["p", "q"], "y", "w")
    got = bl.segment_weights(df, ["p", "q"], "y", "w", "seg0", m, min_rows=100).toPandas().sort_values("row_id")
    folds = np.vstack(got.folds.to_numpy())
    z = np.column_stack([np.ones(n), got.p, got.q, got.y])
    level = got.seg0.fillna("nan").to_numpy()
    for k in range(0, n, 37):
        parts = []
        for r in range(3):
            train = folds[:, r] != folds[k, r]
            own = train & (level == level[k])
            use = own if own.sum() >= 100 else train
            coef, b = bl.METHODS["ridge_pos"]((z[use] * got.w.to_numpy()[use, None]).T @ z[use])
            parts.append(z[k, 1:3] @ coef + b)
        assert got.seg.iloc[k] == pytest.approx(np.clip(np.mean(parts), 0, 100), abs=1e-6)


def test_five_thousand_levels(spark):
    from foldwise.operators import encoders as en

    df = spark.range(12_000).select(F.col("id").alias("row_id"), F.concat(F.lit("l"), F.col("id") % 5_000).alias("c"), F.when(F.col("id") % 3 == 0, F.lit("x")).alias("d"))
    train = df.filter("row_id < 9000 AND row_id % 5000 <> 4999")
    coded, width = en.sparse_one_hot(df, train, ["c", "d"])
    levels = sorted({f"l{i % 5000}" for i in range(9000) if i % 5000 != 4999})
    at = {v: i for i, v in enumerate(levels)}
    assert width == len(levels) + 2
    for r in coded.filter("row_id % 97 = 0 OR row_id = 4999").collect():
        want = ([at[r.c]] if r.c in at else []) + [len(levels) + (1 if r.d == "x" else 0)]
        assert r.onehot == want


# ---- store -----------------------------------------------------------------------


def test_store_replaces_only_written_models(spark):
    path = fresh_path(spark, "store")
    make = lambda m, v: spark.createDataFrame([(m, "train", 1, v), (m, "test", 2, v)], "model string, split string, row_id long, pred double")
    st.write_predictions(make("a", 1.0).union(make("b", 2.0)), path)
    st.write_predictions(make("b", 3.0), path)
    got = {(r.model, r.row_id): r.pred for r in st.read_predictions(spark, path).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 1.0, ("b", 1): 3.0, ("b", 2): 3.0}


def test_upsert_widens(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model string, s double")
    new = spark.createDataFrame([("b", 5.0, True)], "model string, s double, ok boolean")
    assert sorted(map(tuple, st.upsert(old, new, ["model"]).collect())) == [("a", 1.0, None), ("b", 5.0, True)]


# ---- tables that are read again are written once ---------------------------------


@pytest.fixture(scope="module")
def orders_folder(spark, tmp_path_factory):
    """Orders with one to three lines each, six customers."""
    at = tmp_path_factory.mktemp("orders")
    n = 120
    k = F.col("id")
    day = F.expr("timestamp'1995-03-01' + make_interval(cast(id % 5 as int))")
    spark.range(n).select(k.alias("o_orderkey"), (k % 6).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (1000.0 + 7.0 * k).alias("o_totalprice"),
                          day.alias("o_orderdate"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("o_orderpriority")).write.parquet(f"{at}/orders.parquet")
    spark.range(6).select(k.alias("c_custkey"), F.lit("S").alias("c_mktsegment"), (k % 2).cast("int").alias("c_nationkey"), (10.0 * k).alias("c_acctbal")).write.parquet(f"{at}/customer.parquet")
    spark.range(2 * n).select((k % n).alias("l_orderkey"), (1.0 + k % 7).alias("l_quantity"), (10.0 * k).alias("l_extendedprice"), F.lit(0.05).alias("l_discount"),
                              F.lit(0.01).alias("l_tax"), F.when(k % 3 == 0, "R").otherwise("N").alias("l_returnflag"), F.expr("timestamp'1995-04-01'").alias("l_shipdate")).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_folds_and_matrices_read_one_stored_record_table(spark, orders_folder):
    from foldwise.plans import models

    frame, folds = models.frame_and_folds(spark, orders_folder)
    data = models.prepared(spark, orders_folder)
    for table in (frame, folds, data, data.filter("split = 'train'")):
        assert table.count() and not any(orders_folder in f for f in table.inputFiles())
    assert frame.count() == data.count() == 120
    attrs = data.schema["features"].metadata["ml_attr"]["attrs"]
    assert [len(a["vals"]) for a in attrs["nominal"]] == [4, 2, 2]


def test_training_rows_meet_only_the_models_that_held_them_out(spark):
    rows = spark.range(50).select(F.col("id").alias("row_id"), F.when(F.col("id") < 40, "train").otherwise("test").alias("split"), F.lit(1.0).alias("y"),
                                  F.when(F.col("id") < 40, F.array((F.col("id") % 5).cast("int"))).alias("folds"))

    def scorer(fold):
        wrong = (F.col("split") == "train") & (F.col("folds")[0] != fold)
        return lambda df, out: df.withColumn(out, F.when(wrong, F.raise_error(F.lit("scored by a model that saw the row"))).otherwise(10.0 * fold + F.col("y")))

    got = {r.row_id: r.pred for r in oof.score_cells(rows, {(0, f): scorer(f) for f in range(5)}).collect()}
    assert got == {i: 10.0 * (i % 5) + 1 if i < 40 else 21.0 for i in range(50)}


def test_auc_ranks_read_counts_instead_of_scoring_again(spark, tmp_path):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.arange(300) % 2, "y": rng.integers(0, 2, 300).astype(float), "p": rng.integers(0, 9, 300) / 9})
    spark.createDataFrame(pdf).write.parquet(f"{tmp_path}/rows")
    table = mt.roc_auc(spark.read.parquet(f"{tmp_path}/rows"), "y", "p", ["g"])
    assert not any(str(tmp_path) in f for f in table.inputFiles())
    for r in table.collect():
        a, b = (pdf[(pdf.g == r.g) & (pdf.y == v)].p.to_numpy() for v in (1, 0))
        assert r.auc == pytest.approx(((a[:, None] > b) + 0.5 * (a[:, None] == b)).mean())


def test_fits_read_stored_clusters_and_null_targets(spark, monkeypatch):
    made = []
    monkeypatch.setattr(oof, "stored", lambda df, name, real=oof.stored: made.append((name, df.columns)) or real(df, name))
    train = planted_frame(spark).filter("split = 'train'")
    score = oof.clustered(k=2, min_rows=10)(train)
    assert score(train, "p").count() == train.count()
    oof.null_importance(train, 3, draws=2, n_folds=2)
    assert made == [("clusters", ["features", "y", "_k"])] + 2 * [("nulls", ["y", "features", "n0", "n1"])]


def test_moments_refuse_rows_with_other_numbers_of_folds(spark):
    rows = spark.createDataFrame([(1.0, 2.0, [0]), (2.0, 3.0, [1]), (None, 1.0, [1])], "a double, y double, folds array<int>")
    cells = gr.cell_moments(rows.filter("a is not null").coalesce(1), ["a"], "y").cells
    assert np.array_equal(cells[(0, 0)], [[1, 1, 2], [1, 1, 2], [2, 2, 4]]) and np.array_equal(cells[(0, 1)], [[1, 2, 3], [2, 4, 6], [3, 6, 9]])
    assert np.isnan(gr.cell_moments(rows, ["a"], "y").cells[(0, 1)]).any()
    with pytest.raises(Exception, match="same length"):
        gr.cell_moments(spark.createDataFrame([(1.0, 2.0, [0]), (2.0, 3.0, [1, 1])], rows.schema).coalesce(1), ["a"], "y")


def test_cells_and_rounds_read_rows_kept_in_the_executors(spark, monkeypatch):
    """Fits read the stored table from memory, a boosting round scores no tree of earlier rounds again, and nothing stays behind."""
    from pyspark.ml.functions import array_to_vector

    from foldwise.session import stored

    x = F.array(F.col("id") % 7, F.col("id") % 11).cast("array<double>")
    rows = spark.range(200).select(F.col("id").alias("row_id"), F.lit("train").alias("split"), (F.col("id") % 7 * 10.0).alias("y"),
                                   F.array((F.col("id") % 2).cast("int")).alias("folds"), array_to_vector(x).alias("features"))
    data = stored(rows, "model")
    plans, real = [], oof.DecisionTreeRegressor

    class Watched(real):
        def fit(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan"))
            return super().fit(df)

    monkeypatch.setattr(oof, "DecisionTreeRegressor", Watched)
    left = spark.sparkContext._jsc.getPersistentRDDs().size()
    scorers = oof.fit_all(data, oof.huber_boost(5.0, rounds=3, rate=0.5, depth=2), 1, n_folds=2, parallel=1)
    assert len(plans) == 6 and all(len(p) > 1 and "UDF" not in p[0] for p in plans)
    assert not data.is_cached and spark.sparkContext._jsc.getPersistentRDDs().size() == left
    assert oof.score_cells(data, scorers).filter("pred is null").count() == 0
