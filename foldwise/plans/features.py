"""Cleaning, feature and encoder queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import hash_sql
from ..functions.rowwise import missing_flag, row_mean
from ..operators import encoders as en
from ..operators import features as fe
from ..operators import folds as fo
from ..operators import metrics as mt
from ..sources import frame as fr
from ..sources.tables import read_table
from .profiles import per_column, rounded, sides
from .registry import query
from .splits import CELL_BLOCKS, train_and_folds
from .sqlbase import with_blocks

CELL = fo.CELL
NUM = list(fr.NUMERICS)


@query("fe01_clean_types", with_blocks(
    "SELECT row_id, split, score, y2, coalesce(priority, 'nan') AS priority, coalesce(status, 'nan') AS status, coalesce(segment, 'nan') AS segment, "
    "CAST(cohort_year AS DOUBLE) AS cohort_year, CAST(ship_year AS DOUBLE) AS ship_year, " + ", ".join(NUM) + " FROM frame", "frame"))
def clean_types(spark, folder):
    return fe.clean(fr.score_frame(spark, folder))


@query("fe02_numeric_by_exclusion", with_blocks(per_column("SELECT '{c}' AS \"column\", count({c}) AS n_values FROM train", NUM), "train"))
def numeric_by_exclusion(spark, folder):
    from ..operators.profile import non_null_counts

    train, _ = sides(spark, folder)
    return non_null_counts(train, fe.numeric_columns(train.columns), "n_values")


@query("fe03_level_universe", with_blocks(per_column(
    "SELECT '{c}' AS \"column\", lv AS level, CAST(row_number() OVER (ORDER BY lv) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT coalesce({c}, 'nan') AS lv FROM train)", fr.CATEGORIES), "train"))
def level_universe(spark, folder):
    return en.level_universe(sides(spark, folder)[0], fr.CATEGORIES)


FLAGS_SQL = ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in fr.NULLABLE)


@query("fe04_structured_matrix", with_blocks(
    f"SELECT row_id, {', '.join(NUM)}, CAST(cohort_year AS DOUBLE) AS cohort_year, CAST(ship_year AS DOUBLE) AS ship_year, {FLAGS_SQL}, "
    "coalesce(priority, 'nan') AS priority, coalesce(status, 'nan') AS status, coalesce(segment, 'nan') AS segment FROM frame", "frame"))
def structured_matrix(spark, folder):
    return fe.structured_matrix(fr.score_frame(spark, folder))


@query("fe05_missing_flags", with_blocks(f"SELECT row_id, {FLAGS_SQL} FROM frame", "frame"))
def missing_flags(spark, folder):
    return fr.score_frame(spark, folder).select("row_id", *[missing_flag(c) for c in fr.NULLABLE])


MED = list(fr.MEDIAN_FILL)
MED_BLOCK = {"med": "SELECT repeat, fold, " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in MED) + " FROM fitrows GROUP BY ALL"}


@query("fe06_median_impute", with_blocks(
    "SELECT f.repeat, f.fold, t.row_id, " + ", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}, CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in MED) +
    " FROM train t JOIN folds f USING (row_id) JOIN med m ON m.repeat = f.repeat AND m.fold = f.fold", "folds", extra={**CELL_BLOCKS, **MED_BLOCK}))
def median_impute(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    return rounded(en.impute_cells(train.select("row_id", *MED), folds, MED))


@query("fe07_zero_impute", with_blocks("SELECT row_id, coalesce(ret_qty, 0.0) AS ret_qty FROM frame", "frame"))
def zero_impute(spark, folder):
    return fr.score_frame(spark, folder).select("row_id", F.coalesce("ret_qty", F.lit(0.0)).alias("ret_qty"))


@query("fe08_preprocessor", with_blocks(
    "SELECT f.repeat, f.fold, t.row_id, acctbal, round(coalesce(avg_qty, m_avg_qty), 6) AS avg_qty, coalesce(ret_qty, 0.0) AS ret_qty, "
    "CAST(avg_qty IS NULL AS INTEGER) AS avg_qty_missing, CAST(ret_qty IS NULL AS INTEGER) AS ret_qty_missing, "
    + ", ".join(f"CAST(status = '{v}' AS INTEGER) AS status_{v}" for v in "FOP") +
    " FROM train t JOIN folds f USING (row_id) JOIN med m ON m.repeat = f.repeat AND m.fold = f.fold", "folds", extra={**CELL_BLOCKS, **MED_BLOCK}))
def preprocessor(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    levels = en.level_list(train, "status")
    filled = en.impute_cells(train.select("row_id", "acctbal", "avg_qty", "ret_qty", "status"), folds, ["avg_qty"], ["ret_qty"])
    return rounded(filled.select(*[c for c in filled.columns if c != "status"], *en.one_hot(filled, "status", levels)))


@query("fe09_fold_one_hot", with_blocks(
    "SELECT f.repeat, f.fold, t.segment AS level, CAST(bool_or(k.segment IS NOT NULL) AS INTEGER) AS known, count(*) AS n FROM train t JOIN folds f USING (row_id) "
    "LEFT JOIN (SELECT DISTINCT repeat, fold, segment FROM fitrows) k ON k.repeat = f.repeat AND k.fold = f.fold AND k.segment = t.segment GROUP BY ALL", "folds", extra=CELL_BLOCKS))
def fold_one_hot(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    known = en.frequency_encoding(train, folds, "segment").withColumn("known", (F.col("n") > 0).cast("int"))
    sizes = fo.with_cells(train.select("row_id", "segment"), folds).groupBy(*CELL, "segment").agg(F.count("*").alias("n"))
    return sizes.join(known.drop("n"), [*CELL, "segment"], "left").select(*CELL, F.col("segment").alias("level"), F.coalesce("known", F.lit(0)).alias("known"), "n")


@query("fe10_fixed_universe_one_hot", with_blocks(
    "SELECT row_id, " + ", ".join(f"CAST(coalesce(status, 'nan') = '{v}' AS INTEGER) AS status_{v}" for v in "FOP") + " FROM frame", "frame"))
def fixed_universe(spark, folder):
    frame = fr.score_frame(spark, folder)
    m = fe.one_hot_matrix(fr.train_rows(frame), frame)
    return m.select("row_id", *[c for c in m.columns if c.startswith("status_")])


WIDE = ["o_custkey", "o_orderpriority"]


@query("fe10b_sparse_one_hot", """
WITH o AS (SELECT o_orderkey AS row_id, CAST(o_custkey AS VARCHAR) AS a, o_orderpriority AS b FROM orders),
known AS (SELECT * FROM o WHERE row_id % 10 < 7),
la AS (SELECT a, CAST(row_number() OVER (ORDER BY a) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT a FROM known)),
lb AS (SELECT b, CAST(row_number() OVER (ORDER BY b) - 1 + (SELECT count(*) FROM la) AS INTEGER) AS i FROM (SELECT DISTINCT b FROM known))
SELECT row_id, coalesce(la.i, -1) AS customer, coalesce(lb.i, -1) AS priority, CAST((la.i IS NOT NULL)::INT + (lb.i IS NOT NULL)::INT AS INTEGER) AS ones,
  CAST((SELECT count(*) FROM la) + (SELECT count(*) FROM lb) AS INTEGER) AS width
FROM o LEFT JOIN la USING (a) LEFT JOIN lb USING (b)""")
def sparse_one_hot(spark, folder):
    """A category with thousands of levels as positions of a sparse row, beside a narrow one."""
    orders = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), *WIDE)
    known = orders.filter(F.col("row_id") % 10 < 7)
    coded, width = en.sparse_one_hot(orders, known, WIDE)
    narrow = en.level_universe(known, WIDE).filter(F.col("column") == WIDE[0]).count()
    first = F.filter("onehot", lambda i: i < narrow)
    second = F.filter("onehot", lambda i: i >= narrow)
    at = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(-1))
    return coded.select("row_id", at(first).alias("customer"), at(second).alias("priority"), F.size("onehot").alias("ones"), F.lit(width).alias("width"))


@query("fe11_ordinal_codes", with_blocks(
    "SELECT row_id, coalesce(code, -1) AS priority_code FROM test LEFT JOIN (SELECT lv, CAST(row_number() OVER (ORDER BY lv) - 1 AS INTEGER) AS code FROM "
    "(SELECT DISTINCT coalesce(priority, 'nan') AS lv FROM train)) ON lv = coalesce(priority, 'nan')", "train", "test"))
def ordinal_codes(spark, folder):
    train, test = sides(spark, folder)
    return en.ordinal_codes(test.select("row_id", "priority"), train, ["priority"]).select("row_id", "priority_code")


AUTO = """CASE WHEN n > 0 THEN (coalesce(vy * n / nullif(vy * n + vi, 0), 1)) * m + (1 - coalesce(vy * n / nullif(vy * n + vi, 0), 1)) * my ELSE my END"""
TE_BLOCK = {
    "tot": "SELECT repeat, fold, avg(score) AS my, var_pop(score) AS vy FROM fitrows GROUP BY ALL",
    "lev": "SELECT repeat, fold, segment, CAST(count(*) AS DOUBLE) AS n, avg(score) AS m, var_pop(score) AS vi FROM fitrows GROUP BY ALL",
}


@query("fe12_target_encoding", with_blocks(
    f"SELECT repeat, fold, segment, n, round({AUTO}, 6) AS enc FROM lev JOIN tot USING (repeat, fold)", "folds", extra={**CELL_BLOCKS, **TE_BLOCK}))
def target_encoding(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    return rounded(en.target_encoding(train, folds, "segment", "score"), keep=("n",))


INNER = f"CAST({hash_sql('row_id', 42)} % 5 AS INTEGER)"


@query("fe12b_cross_fitted_encoding", with_blocks(
    f"SELECT repeat, fold, i AS \"inner\", segment, n, round({AUTO}, 6) AS enc FROM ilev JOIN itot USING (repeat, fold, i)", "folds", extra={
        **CELL_BLOCKS, "irows": f"SELECT f.*, g.i FROM fitrows f, (SELECT unnest(range(5))::INTEGER AS i) g WHERE {INNER} <> g.i",
        "itot": "SELECT repeat, fold, i, avg(score) AS my, var_pop(score) AS vy FROM irows GROUP BY ALL",
        "ilev": "SELECT repeat, fold, i, segment, CAST(count(*) AS DOUBLE) AS n, avg(score) AS m, var_pop(score) AS vi FROM irows GROUP BY ALL"}))
def cross_fitted(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    return rounded(en.cross_fitted_encoding(train, folds, "segment", "score", fo.inner_split("row_id", 42, 0)), keep=("n",))


GM = "(coalesce(avg_qty, 0) + coalesce(ret_qty, 0) + coalesce(disc_pts, 0) + coalesce(tax_pts, 0)) / nullif((avg_qty IS NOT NULL)::INT + (ret_qty IS NOT NULL)::INT + (disc_pts IS NOT NULL)::INT + (tax_pts IS NOT NULL)::INT, 0)"
LIST4 = "list_filter([avg_qty, ret_qty, disc_pts, tax_pts], lambda x: x IS NOT NULL)"


@query("fe13_row_group_mean", with_blocks(f"SELECT row_id, round({GM}, 6) AS group_mean FROM frame", "frame"))
def row_group_mean(spark, folder):
    return rounded(fr.score_frame(spark, folder).select("row_id", row_mean(fr.SCORE_GROUP).alias("group_mean")))


@query("fe14_row_group_std", with_blocks(
    f"SELECT row_id, round(CASE WHEN len(v) > 1 THEN list_stddev_samp(v) END, 6) AS group_std FROM (SELECT row_id, {LIST4} AS v FROM frame)", "frame"))
def row_group_std(spark, folder):
    from ..functions.rowwise import row_std

    return rounded(fr.score_frame(spark, folder).select("row_id", row_std(fr.SCORE_GROUP).alias("group_std")))


DERIVED_SQL = f"""SELECT row_id, qty_mean, pts_mean, all_mean,
 CASE WHEN len(v) > 1 THEN list_stddev_samp(v) END AS all_std,
 CASE WHEN disc_pts IS NOT NULL AND tax_pts IS NOT NULL THEN abs(disc_pts - tax_pts) / sqrt(2.0::DOUBLE) END AS pts_std,
 n_lines * qty_mean AS lines_x_qty, qty_mean * pts_mean AS qty_x_pts, coalesce(n_lines, 0) + coalesce(n_ret, 0) AS total_counts,
 n_lines + n_ret AS strict_counts, n_ret / (n_lines + 1) AS return_rate, ship_year - cohort_year AS year_gap,
 ln(1 + ext_price) AS ext_price_log1p, ln(1 + sum_qty) AS sum_qty_log1p
FROM (SELECT *, coalesce((avg_qty + ret_qty) / 2, avg_qty, ret_qty) AS qty_mean, coalesce((disc_pts + tax_pts) / 2, disc_pts, tax_pts) AS pts_mean,
 {GM} AS all_mean, {LIST4} AS v FROM frame)"""
DER = {"d": DERIVED_SQL}


EXACT = ("lines_x_qty", "qty_x_pts")  # products of short decimals: nine digits hold them exactly


def _derived(spark, folder, *cols):
    d = fe.derived(fr.score_frame(spark, folder)).select("row_id", *cols)
    return rounded(d.select("row_id", *[F.round(c, 9).alias(c) if c in EXACT else F.col(c) for c in cols]), keep=EXACT)


def _dsql(*cols):
    return with_blocks("SELECT row_id, " + ", ".join(f"round({c}, {9 if c in EXACT else 6}) AS {c}" if c != "year_gap" else c for c in cols) + " FROM d", "frame", extra=DER)


@query("fe15_products", _dsql("lines_x_qty", "qty_x_pts"))
def products(spark, folder):
    return _derived(spark, folder, "lines_x_qty", "qty_x_pts")


@query("fe16_totals_and_rate", _dsql("total_counts", "strict_counts", "return_rate"))
def totals(spark, folder):
    return _derived(spark, folder, "total_counts", "strict_counts", "return_rate")


@query("fe17_year_gap", _dsql("year_gap"))
def year_gap(spark, folder):
    return _derived(spark, folder, "year_gap")


@query("fe18_log1p", _dsql("ext_price_log1p", "sum_qty_log1p"))
def logs(spark, folder):
    return _derived(spark, folder, "ext_price_log1p", "sum_qty_log1p")


D_ALL = ["qty_mean", "pts_mean", "all_mean", "all_std", "pts_std", "lines_x_qty", "qty_x_pts", "total_counts", "strict_counts", "return_rate", "year_gap", "ext_price_log1p", "sum_qty_log1p"]


@query("fe19_all_derived", _dsql(*D_ALL))
def all_derived(spark, folder):
    return _derived(spark, folder, *D_ALL)


@query("fe20_add_columns", with_blocks(
    f"SELECT f.row_id, {', '.join('f.' + c for c in NUM)}, round(all_mean, 6) AS all_mean, round(return_rate, 6) AS return_rate FROM frame f LEFT JOIN d USING (row_id)", "frame", extra=DER))
def add_columns(spark, folder):
    frame = fr.score_frame(spark, folder)
    d = fe.derived(frame).select("row_id", F.round("all_mean", 6).alias("all_mean"), F.round("return_rate", 6).alias("return_rate"))
    return fe.add_columns(frame.select("row_id", *NUM), d, ["all_mean", "return_rate"])


@query("fe21_add_text_columns", with_blocks(
    "SELECT f.row_id, f.n_lines, p.pred_e AS text_pred, CAST(len(d.text) AS BIGINT) AS len_char FROM frame f LEFT JOIN preds p USING (row_id) LEFT JOIN documents d ON d.doc_id = f.row_id", "frame", "preds"))
def add_text_columns(spark, folder):
    frame = fr.score_frame(spark, folder)
    text = fr.prediction_frame(frame).select("row_id", F.col("pred_e").alias("text_pred"))
    lex = fr.text_frame(spark, folder).select("row_id", F.length("text").cast("long").alias("len_char"))
    return fe.add_columns(fe.add_columns(frame.select("row_id", "n_lines"), text, ["text_pred"]), lex, ["len_char"])


@query("fe22_text_categories", with_blocks(
    "SELECT row_id, coalesce(priority, 'nan') AS priority, coalesce(status, 'nan') AS status, coalesce(CAST(ship_year AS VARCHAR), 'nan') AS ship_year FROM frame", "frame"))
def text_categories(spark, folder):
    return fr.score_frame(spark, folder).select("row_id", *[fe.category(c).alias(c) for c in ("priority", "status", "ship_year")])


@query("fe23_fold_standard_scale", with_blocks(
    "SELECT f.repeat, f.fold, t.row_id, round((acctbal - m) / s, 6) AS z FROM train t JOIN folds f USING (row_id) JOIN "
    "(SELECT repeat, fold, avg(acctbal) AS m, stddev_pop(acctbal) AS s FROM fitrows GROUP BY ALL) g ON g.repeat = f.repeat AND g.fold = f.fold", "folds", extra=CELL_BLOCKS))
def fold_standard_scale(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    return rounded(en.scale_cells(train.select("row_id", "acctbal"), folds, "acctbal", "z").select("row_id", *CELL, "z"))


ROB = ["acctbal", "avg_qty", "n_ret", "ext_price"]


@query("fe24_robust_scale", with_blocks(
    per_column("SELECT '{c}' AS \"column\", round(md, 6) AS median, round(CASE WHEN q3 - q1 > 1e-9 THEN (q3 - q1) / 1.349 WHEN sd > 1e-9 THEN sd ELSE 1 END, 6) AS scale FROM "
               "(SELECT any_value(md) AS md, quantile_cont(coalesce({c}, md), 0.25) AS q1, quantile_cont(coalesce({c}, md), 0.75) AS q3, stddev_pop(coalesce({c}, md)) AS sd "
               "FROM frame, (SELECT quantile_cont({c}, 0.5) AS md FROM frame))", ROB), "frame"))
def robust_scale(spark, folder):
    return rounded(en.robust_scale(*sides(spark, folder), ROB))


@query("fe25_target_z", with_blocks(
    "SELECT f.repeat, f.fold, t.row_id, round((score - m) / s, 6) AS z, round((score - m) / s * s + m, 6) AS back FROM train t JOIN folds f USING (row_id) JOIN "
    "(SELECT repeat, fold, avg(score) AS m, stddev_pop(score) AS s FROM fitrows GROUP BY ALL) g ON g.repeat = f.repeat AND g.fold = f.fold", "folds", extra=CELL_BLOCKS))
def target_z(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    stats = F.broadcast(en.cell_moments(train, folds, "score"))
    z = (F.col("score") - F.col("mean")) / F.col("std")
    return rounded(fo.with_cells(train.select("row_id", "score"), folds).join(stats, CELL).select(
        "row_id", *CELL, z.alias("z"), (z * F.col("std") + F.col("mean")).alias("back")))


@query("fe28_frequency_encoding", with_blocks(
    "SELECT repeat, fold, segment, count(*) AS n FROM fitrows GROUP BY ALL", "folds", extra=CELL_BLOCKS))
def frequency_encoding(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    return en.frequency_encoding(train, folds, "segment")


Z_COLS = ["acctbal", "avg_qty"]


@query("fe29_cohort_z", with_blocks(
    "SELECT row_id, " + ", ".join(
        f"round(({c} - avg({c}) OVER (PARTITION BY {by})) / nullif(stddev_pop({c}) OVER (PARTITION BY {by}), 0), 5) AS {c}_z_{tag}"
        for tag, by in (("year", "cohort_year"), ("segment", "segment"), ("both", "segment, cohort_year")) for c in Z_COLS) + " FROM frame", "frame"))
def cohort_z(spark, folder):
    return rounded(fe.cohort_z(fr.score_frame(spark, folder), Z_COLS, {
        "year": ["cohort_year"], "segment": ["segment"], "both": ["segment", "cohort_year"]}), 5)


@query("fe30_cohort_rank", with_blocks(
    "SELECT row_id, round(percent_rank() OVER (PARTITION BY cohort_year ORDER BY acctbal), 6) AS pr FROM frame", "frame"))
def cohort_rank(spark, folder):
    frame = fr.score_frame(spark, folder).select("row_id", "cohort_year", "acctbal")
    return rounded(fe.cohort_rank(frame, "acctbal", ["cohort_year"], "pr").select("row_id", "pr"))


@query("fe31_hierarchical_encoding", with_blocks(
    "SELECT a.repeat, a.fold, a.segment, a.cohort_year, round((a.s + 20.0 * ((b.s + 20.0 * (c.s / c.n)) / (b.n + 20.0))) / (a.n + 20.0), 6) AS enc FROM "
    "(SELECT repeat, fold, segment, cohort_year, count(*) AS n, sum(score) AS s FROM fitrows GROUP BY ALL) a JOIN "
    "(SELECT repeat, fold, segment, count(*) AS n, sum(score) AS s FROM fitrows GROUP BY ALL) b USING (repeat, fold, segment) JOIN "
    "(SELECT repeat, fold, count(*) AS n, sum(score) AS s FROM fitrows GROUP BY ALL) c USING (repeat, fold)", "folds", extra=CELL_BLOCKS))
def hierarchical_encoding(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    return rounded(en.hierarchical_encoding(train, folds, "segment", "cohort_year", "score"))


@query("fe32_weighted_encoding", with_blocks(
    "SELECT a.repeat, a.fold, a.segment, round(a.n, 6) AS n, round((a.s + 30.0 * (c.s / c.n)) / (a.n + 30.0), 6) AS enc FROM "
    "(SELECT repeat, fold, segment, sum(w) AS n, sum(w * score) AS s FROM fitrows JOIN weights USING (row_id) GROUP BY ALL) a JOIN "
    "(SELECT repeat, fold, sum(w) AS n, sum(w * score) AS s FROM fitrows JOIN weights USING (row_id) GROUP BY ALL) c USING (repeat, fold)", "folds", "weights", extra=CELL_BLOCKS))
def weighted_encoding(spark, folder):
    frame, train, folds = train_and_folds(spark, folder)
    weighted = mt.importance_weights(train, fr.test_rows(frame), "cohort_year")
    return rounded(en.mean_encoding(weighted, folds, ["segment"], "score", 30.0, weight=F.col("w")))


@query("fe33_profile_shape", with_blocks(
    f"SELECT row_id, round(CASE WHEN len(v) > 1 THEN list_stddev_samp(v) END, 6) AS shape_std, round(list_avg(v), 6) AS shape_mean, round(list_max(v) - list_min(v), 6) AS shape_range FROM (SELECT row_id, {LIST4} AS v FROM frame)", "frame"))
def profile_shape(spark, folder):
    return rounded(fe.profile_shape(fr.score_frame(spark, folder), fr.SCORE_GROUP))


RATIOS = {"qty_per_line": ("sum_qty", "n_lines"), "price_per_qty": ("ext_price", "sum_qty"), "price_per_line": ("ext_price", "n_lines"),
          "returns_per_line": ("n_ret", "n_lines"), "ret_vs_avg": ("ret_qty", "avg_qty"), "disc_vs_tax": ("disc_pts", "tax_pts"), "qty_vs_disc": ("avg_qty", "disc_pts")}


@query("fe34_ratios_and_asymmetry", with_blocks(
    "SELECT f.repeat, f.fold, t.row_id, " + ", ".join(f"round({a} / ({b} + 1), 8) AS {n}" for n, (a, b) in RATIOS.items()) +
    ", round((disc_pts - tax_pts - m) / s, 8) AS asymmetry_z FROM train t JOIN folds f USING (row_id) JOIN (SELECT repeat, fold, avg(disc_pts - tax_pts) AS m, "
    "stddev_pop(disc_pts - tax_pts) AS s FROM fitrows GROUP BY ALL) g ON g.repeat = f.repeat AND g.fold = f.fold", "folds", extra=CELL_BLOCKS))
def ratios(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    z = en.scale_cells(train.select("row_id", (F.col("disc_pts") - F.col("tax_pts")).alias("a")), folds, "a", "asymmetry_z").drop("a")
    return rounded(z.join(fe.efficiency_ratios(train, RATIOS), "row_id"), 8)


BINNED = ["acctbal", "avg_qty", "disc_pts", "tax_pts", "sum_qty", "ext_price"]


@query("fe35_fold_quantile_bins", with_blocks(
    per_column("SELECT t.row_id, f.repeat, f.fold, '{c}' AS \"column\", CASE WHEN {c} IS NOT NULL THEN CAST(len(list_filter(list_distinct(e), lambda x: x > e[1] AND x < e[6] AND x < {c})) AS INTEGER) END AS bin "
               "FROM train t JOIN folds f USING (row_id) JOIN (SELECT repeat, fold, list_transform(quantile_cont({c}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda x: round(x, 6)) AS e FROM fitrows GROUP BY ALL) q "
               "ON q.repeat = f.repeat AND q.fold = f.fold", BINNED), "folds", extra=CELL_BLOCKS))
def fold_quantile_bins(spark, folder):
    _, train, folds = train_and_folds(spark, folder)
    return fe.cell_bins(train, folds, BINNED)


@query("fe36_disagreement", with_blocks(
    "SELECT row_id, round(abs(pred_e - pred_a), 6) AS text_num_gap, round(pred_e - pred_a, 6) AS text_num_signed, round(list_stddev_samp([pred_a, pred_b, pred_c, pred_d, pred_e]), 6) AS model_std, "
    + ", ".join(f"round({m} - (pred_a + pred_b + pred_c + pred_d + pred_e) / 5, 6) AS {m}_gap" for m in fr.MODELS) + " FROM preds", "preds"))
def disagreement(spark, folder):
    return rounded(fe.disagreement(fr.prediction_frame(fr.score_frame(spark, folder)), fr.MODELS, "pred_e", "pred_a"))


@query("fe39_lattice", with_blocks(
    "SELECT row_id, CAST(round(score * 100) AS BIGINT) % 10 AS last_digit, CAST(round(score * 100) AS BIGINT) % 25 AS lattice_25, "
    "CAST(CAST(round(score * 100) AS BIGINT) % 100 = 0 AS INTEGER) AS is_integer, count(*) OVER (PARTITION BY score) AS value_freq FROM train", "train"))
def lattice(spark, folder):
    return fe.lattice(sides(spark, folder)[0], "score")


@query("fe40_pair_scan", with_blocks(
    "SELECT pair, corr FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, '{a}*{b}' AS pair, round(corr({a} * {b}, y2), 6) AS corr FROM train UNION ALL SELECT '{a}', '{b}', '{a}/{b}', round(corr({a} / (abs({b}) + 1), y2), 6) FROM train"
        for i, a in enumerate(sorted(NUM)) for b in sorted(NUM)[i + 1:]) +
    ") WHERE a IN (SELECT c FROM best) AND b IN (SELECT c FROM best) ORDER BY abs(corr) DESC NULLS LAST, pair LIMIT 12", "train", extra={
        "best": "SELECT c FROM (" + per_column("SELECT '{c}' AS c, abs(corr({c}, y2)) AS r FROM train", NUM) + ") ORDER BY r DESC NULLS LAST, c LIMIT 5"}))
def pair_scan(spark, folder):
    return rounded(fe.pair_scan(sides(spark, folder)[0], NUM, fr.PLANTED, 5, 12))
