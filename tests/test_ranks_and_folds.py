import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.functions.keyed import PRIME, hash_sql, keyed_hash
from foldwise.operators import encoders as en
from foldwise.operators import folds as fo
from foldwise.operators import metrics as mt
from foldwise.operators.ranks import bin_of, exact_quantiles, quantile_edges, rank_table, row_numbers


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, which is also the cap."""
    rng = np.random.default_rng(1)
    y = np.round(np.where(rng.random(3000) < 0.34, 100.0, rng.gamma(4.0, 12.0, 3000).clip(0, 99)), 1)
    pdf = pd.DataFrame({"row_id": np.arange(3000), "y": y})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("domain", [None, (0.0, 100.0)])
def test_quantiles_equal_numpy(skewed, domain):
    pdf, df = skewed
    probs = [0.0, 1 / 9, 0.25, 0.5, 0.9, 1.0]
    got = list(exact_quantiles(df, "y", probs, (), domain).first())
    assert np.allclose(got, np.quantile(pdf.y, probs), atol=1e-12)


def test_ranks_equal_pandas(skewed):
    pdf, df = skewed
    got = rank_table(df, "y", "r", (), (0.0, 100.0)).toPandas().set_index("y").r
    want = pdf.assign(r=pdf.y.rank()).drop_duplicates("y").set_index("y").r
    assert np.allclose(got.loc[want.index], want)


def test_bins_equal_qcut_with_heavy_ties(skewed):
    pdf, df = skewed
    below = pdf[pdf.y < 100]
    edges = quantile_edges(df.filter("y < 100"), "y", 9, (0.0, 100.0))
    got = df.filter("y < 100").select("row_id", bin_of("y", edges).alias("b")).toPandas().set_index("row_id").b
    want = pd.qcut(below.y, 9, labels=False, duplicates="drop")
    assert (got.loc[below.row_id].to_numpy() == want.to_numpy()).all()


def test_row_numbers_equal_a_sort(skewed):
    pdf, df = skewed
    got = row_numbers(df.withColumn("h", keyed_hash("row_id", 3)), [], "h", "row_id", (0, PRIME)).select("row_id", "h", "rn").toPandas()
    want = got.sort_values(["h", "row_id"])
    assert (want.rn.to_numpy() == np.arange(1, len(want) + 1)).all()


def test_hash_has_no_overflow_for_large_keys(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000_000,), (0,), (2**31,)], "k long")
    vals = [r[0] for r in df.select(keyed_hash("k", 2026)).collect()]
    assert all(0 <= v < PRIME for v in vals)
    assert "%" in hash_sql("k", 1)


def test_folds_cover_and_balance(skewed):
    _, df = skewed
    folds = fo.stratified_folds(df, "y")
    assert fo.cover_violations(df, folds).count() == 0
    cells = fo.validate_folds(df, folds, "y").toPandas()
    assert len(cells) == 15 and cells.balanced.all()
    # repeats are different partitions
    wide = folds.groupBy("row_id").pivot("repeat").agg(F.first("fold")).toPandas()
    assert abs(np.corrcoef(wide["0"], wide["1"])[0, 1]) < 0.1


def test_folds_do_not_depend_on_partitioning(skewed):
    _, df = skewed
    a = fo.stratified_folds(df, "y").orderBy("row_id", "repeat").collect()
    b = fo.stratified_folds(df.repartition(7), "y").orderBy("row_id", "repeat").collect()
    assert a == b


def test_duplicate_edges_leave_no_empty_bin(spark):
    df = spark.createDataFrame([(i, float(i % 3) * 10) for i in range(300)], "row_id long, y double")
    sizes = fo.strat_bins(df, "y").groupBy("bin").count().collect()
    assert 1 < len(sizes) <= 3


def test_cell_medians_equal_brute_force(skewed):
    pdf, df = skewed
    folds = fo.stratified_folds(df, "y")
    got = en.cell_medians(df, folds, ["y"]).toPandas()
    f = folds.toPandas()
    for r in got.itertuples():
        rows = f[(f.repeat == r.repeat) & (f.fold != r.fold)].row_id
        assert r.median == pytest.approx(np.median(pdf.y.loc[rows]))


def test_encoding_of_a_cell_ignores_its_own_target(skewed, spark):
    """Poison test: a changed target inside one cell leaves that cell's encoding alone."""
    _, df = skewed
    base = df.withColumn("level", (F.col("row_id") % 4).cast("string"))
    folds = fo.stratified_folds(base, "y").cache()
    hit = folds.filter("repeat = 1 AND fold = 2").select("row_id", F.lit(1).alias("hit"))
    bad = base.join(hit, "row_id", "left").withColumn("y", F.when(F.col("hit") == 1, -500.0).otherwise(F.col("y"))).drop("hit")
    pick = lambda d: en.target_encoding(d, folds, "level", "y").filter("repeat = 1").toPandas().set_index(["fold", "level"]).enc.sort_index()
    a, b = pick(base), pick(bad)
    assert np.allclose(a.loc[2], b.loc[2]) and not np.allclose(a.loc[0], b.loc[0])


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.5), (1, 0.5), (1, 0.9)], "y int, p double")
    assert mt.roc_auc(df, "y", "p", (), (0.0, 1.0)).first()["auc"] == pytest.approx(0.875)
    assert mt.roc_auc(df.filter("y = 1"), "y", "p", (), (0.0, 1.0)).first()["auc"] is None


def test_bootstrap_interval_covers_and_twin_fails(spark):
    rng = np.random.default_rng(2)
    n = 2000
    e0 = rng.gamma(2.0, 10.0, n)
    pdf = pd.DataFrame({"row_id": np.arange(n), "w": 1.0, "e0": e0, "e1": e0 - 1.0 + rng.normal(0, 5, n)})
    df = spark.createDataFrame(pdf)
    one = mt.bootstrap_interval(mt.bootstrap_deltas(df, "row_id", F.col("w"), F.col("e0"), F.col("e1"), 1000)).first()
    d = pdf.e1 - pdf.e0
    half = 1.96 * d.std() / np.sqrt(n)
    assert one.ci_lo == pytest.approx(d.mean() - half, abs=0.08) and one.ci_hi == pytest.approx(d.mean() + half, abs=0.08)
    again = mt.bootstrap_interval(mt.bootstrap_deltas(df.repartition(5), "row_id", F.col("w"), F.col("e0"), F.col("e1"), 1000)).first()
    assert again.delta_mean == pytest.approx(one.delta_mean, abs=1e-9)
    twin = mt.bootstrap_interval(mt.bootstrap_deltas(df, "row_id", F.col("w"), F.col("e0"), F.col("e0"), 200)).first()
    assert twin.p_ge0 == 1.0


def test_density_ratio_finds_a_shift(spark):
    rng = np.random.default_rng(3)
    tr = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(800), "a": rng.normal(0, 1, 800)}))
    te = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(800), "a": rng.normal(1, 1, 800)}))
    info, weighted = mt.density_ratio(tr, te, ["a"])
    w = weighted(0.1).select("a", "w").toPandas()
    assert w.w.mean() == pytest.approx(1.0) and np.corrcoef(w.a, w.w)[0, 1] > 0.5
    assert 0 < info[0]["ess_frac"] <= 1


def test_clip_keeps_missing_and_odd_values(spark):
    from foldwise.functions.rowwise import clip

    rows = [(None,), (float("nan"),), (-3.0,), (50.0,), (250.0,), (float("inf"),)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(clip("x")).collect()]
    assert got[0] is None and got[1] != got[1] and got[2:5] == [0.0, 50.0, 100.0] and got[5] != got[5]


def test_text_ids_get_the_same_number_in_sql(spark):
    import duckdb

    from foldwise.functions.keyed import text_key, text_key_sql

    ids = ["STU_000150", "", "é", "12"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x string").select(text_key("x")).collect()]
    assert got == [duckdb.connect().execute(f"SELECT {text_key_sql(repr(i))}").fetchall()[0][0] for i in ids]
