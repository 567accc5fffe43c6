"""Profiling and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rowwise import row_mean, safe_ratio
from ..functions.textexpr import fold_case_py
from ..operators import profile as pr
from ..sources import frame as fr
from .registry import query
from .sqlbase import with_blocks

NUM = list(fr.NUMERICS)
ROLES = {**{c: "numeric" for c in NUM}, **{c: "year" for c in fr.YEARS}, **{c: "category" for c in fr.CATEGORIES},
         fr.TARGET: "target", fr.KEY: "id"}
ALL = [*NUM, *fr.YEARS, *fr.CATEGORIES]


def sides(spark, folder):
    frame = fr.score_frame(spark, folder)
    return fr.train_rows(frame), fr.test_rows(frame)


def rounded(df, digits=6, keep=()):
    """Round every double column of a small report."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" and f.name not in keep else F.col(f.name)
                       for f in df.schema.fields])


def per_column(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("pr01_schema_difference", with_blocks(
    per_column("SELECT '{c}' AS \"column\", 'train_only' AS side, count({c}) AS n_values FROM train", ["score", "y2"]), "train"))
def schema_difference(spark, folder):
    train, test = sides(spark, folder)
    return pr.schema_difference(train, test.drop(fr.TARGET, fr.PLANTED))


@query("pr02_id_format", with_blocks(
    "SELECT (SELECT count(*) FROM frame WHERE NOT regexp_matches(CAST(row_id AS VARCHAR), '^[0-9]+$')) AS n_malformed, "
    "(SELECT count(*) FROM (SELECT row_id FROM train INTERSECT SELECT row_id FROM test)) AS n_overlap, "
    "(SELECT count(*) FROM frame) AS n_rows", "train", "test"))
def id_format(spark, folder):
    frame = fr.score_frame(spark, folder)
    per_id = frame.groupBy("row_id").agg(F.countDistinct("split").alias("sides"), F.count("*").alias("n"))
    return per_id.agg(
        F.sum((~F.col("row_id").cast("string").rlike("^[0-9]+$")).cast("long") * F.col("n")).alias("n_malformed"),
        F.sum((F.col("sides") > 1).cast("long")).alias("n_overlap"), F.sum("n").alias("n_rows"))


@query("pr03_role_counts", with_blocks(
    "SELECT role, count(*) AS n_columns, CAST(sum(n) AS BIGINT) AS n_values FROM (" + per_column(
        "SELECT '{c}' AS c, count({c}) AS n FROM train", ROLES) + ") JOIN (VALUES " + ", ".join(f"('{c}', '{r}')" for c, r in ROLES.items()) +
    ") AS m(c, role) USING (c) GROUP BY role", "train"))
def role_counts(spark, folder):
    train, _ = sides(spark, folder)
    role = F.create_map(*[F.lit(x) for p in ROLES.items() for x in p])
    return pr.non_null_counts(train, list(ROLES), "n").groupBy(role[F.col("column")].alias("role")).agg(
        F.count("*").alias("n_columns"), F.sum("n").alias("n_values"))


MOMENTS = """SELECT n, mean, sqrt(m2) AS std_pop, sqrt(m2 * n / (n - 1)) AS std_samp, m2 * n / (n - 1) AS var_samp, lo AS min, hi AS max,
 m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurtosis, pct_cap, pct_low, n_zero, median FROM (
 SELECT count(*) AS n, any_value(m) AS mean, avg(pow(score - m, 2)) AS m2, avg(pow(score - m, 3)) AS m3, avg(pow(score - m, 4)) AS m4,
  min(score) AS lo, max(score) AS hi, 100.0 * avg(CASE WHEN score >= 100 THEN 1.0 ELSE 0.0 END) AS pct_cap,
  100.0 * avg(CASE WHEN score <= 50 THEN 1.0 ELSE 0.0 END) AS pct_low, count(*) FILTER (WHERE score <= 0) AS n_zero,
  quantile_cont(score, 0.5) AS median FROM train, (SELECT avg(score) AS m FROM train))"""


@query("pr04_target_profile", with_blocks(
    "SELECT n, n_zero, round(mean, 6) AS mean, round(std_pop, 6) AS std_pop, round(std_samp, 6) AS std_samp, round(var_samp, 6) AS var_samp, "
    "min, max, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(pct_cap, 6) AS pct_cap, round(pct_low, 6) AS pct_low, round(median, 6) AS median FROM m",
    "train", extra={"m": MOMENTS}))
def target_profile(spark, folder):
    return rounded(pr.target_profile(sides(spark, folder)[0], fr.TARGET))


@query("pr05_histogram", with_blocks(
    "SELECT CAST(least(floor((score - lo) / ((hi - lo) / 50.0::DOUBLE)), 49) AS INTEGER) AS slot, count(*) AS n "
    "FROM train, (SELECT min(score) AS lo, max(score) AS hi FROM train) GROUP BY 1", "train"))
def histogram(spark, folder):
    return pr.histogram(sides(spark, folder)[0], fr.TARGET)


@query("pr05b_ecdf", with_blocks("SELECT DISTINCT score, round(cume_dist() OVER (ORDER BY score), 6) AS cdf FROM train", "train"))
def ecdf(spark, folder):
    return rounded(pr.ecdf(sides(spark, folder)[0], fr.TARGET, (0.0, 100.0)), keep=("score",))


def _missing(side):
    return per_column("SELECT '{c}' AS c, count(*) - count({c}) AS n, round(100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS p FROM " + side, fr.NULLABLE)


@query("pr06_missing_map", with_blocks(
    f"SELECT a.c AS \"column\", a.n AS n_missing_train, a.p AS pct_missing_train, b.n AS n_missing_test, b.p AS pct_missing_test FROM ({_missing('train')}) a JOIN ({_missing('test')}) b USING (c)",
    "train", "test"))
def missing_map(spark, folder):
    return rounded(pr.missing_map(*sides(spark, folder), fr.NULLABLE))


MNAR = {"ret_qty": "n_ret", "disc_pts": "n_ret", "avg_qty": "n_ret"}


@query("pr07_mnar_test", with_blocks(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(o, 6) AS zero_overall, round(g, 6) AS zero_given_null, coalesce(g > 2 * o AND g > 0.5, FALSE) AS mnar FROM "
        f"(SELECT avg(CASE WHEN {r} = 0 THEN 1.0 ELSE 0.0 END) AS o, avg(CASE WHEN {c} IS NULL THEN CASE WHEN {r} = 0 THEN 1.0 ELSE 0.0 END END) AS g FROM train)"
        for c, r in MNAR.items()), "train"))
def mnar_test(spark, folder):
    return rounded(pr.mnar_test(sides(spark, folder)[0], MNAR))


@query("pr08_same_mask", with_blocks(
    "SELECT bool_and((disc_pts IS NULL) = (tax_pts IS NULL)) AS same_mask, count(*) FILTER (WHERE disc_pts IS NULL) AS n_missing, "
    "round(100.0 * avg(CASE WHEN disc_pts IS NULL THEN CASE WHEN coalesce(n_lines, 0) > 0 THEN 1.0 ELSE 0.0 END END), 6) AS pct_related FROM train", "train"))
def same_mask(spark, folder):
    return rounded(pr.same_mask(sides(spark, folder)[0], "disc_pts", "tax_pts", "n_lines"))


@query("pr09_category_levels", with_blocks(
    per_column(
        "SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM train) AS n_train, (SELECT count(DISTINCT {c}) FROM test) AS n_test, "
        "(SELECT count(*) FROM (SELECT {c} FROM train WHERE {c} IS NOT NULL EXCEPT SELECT {c} FROM test)) AS n_train_only, "
        "(SELECT count(*) FROM (SELECT {c} FROM test WHERE {c} IS NOT NULL EXCEPT SELECT {c} FROM train)) AS n_test_only", fr.CATEGORIES), "train", "test"))
def category_levels(spark, folder):
    return pr.category_levels(*sides(spark, folder), fr.CATEGORIES)


@query("pr10_target_correlation", with_blocks(
    per_column("SELECT '{c}' AS \"column\", round(corr({c}, y2), 6) AS corr FROM train", NUM), "train"))
def target_correlation(spark, folder):
    return rounded(pr.correlations(sides(spark, folder)[0], NUM, fr.PLANTED)).orderBy(F.abs("corr").desc())


@query("pr11_correlation_matrix", with_blocks(
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM train" for i, a in enumerate(NUM) for b in NUM[i:]), "train"))
def correlation_matrix(spark, folder):
    return rounded(pr.correlation_matrix(sides(spark, folder)[0], NUM))


@query("pr12_heuristic_features", with_blocks(
    "SELECT round(corr(g, y2), 6) AS group_mean, round(corr(g * n_lines, y2), 6) AS product, round(corr(n_ret / nullif(n_lines, 0), y2), 6) AS ratio FROM "
    "(SELECT *, (coalesce(avg_qty, 0) + coalesce(ret_qty, 0) + coalesce(disc_pts, 0) + coalesce(tax_pts, 0)) / "
    "nullif((avg_qty IS NOT NULL)::INT + (ret_qty IS NOT NULL)::INT + (disc_pts IS NOT NULL)::INT + (tax_pts IS NOT NULL)::INT, 0) AS g FROM train)", "train"))
def heuristic_features(spark, folder):
    train = sides(spark, folder)[0].withColumn("g", row_mean(fr.SCORE_GROUP))
    return rounded(train.agg(
        F.corr("g", fr.PLANTED).alias("group_mean"), F.corr(F.col("g") * F.col("n_lines"), F.col(fr.PLANTED)).alias("product"),
        F.corr(safe_ratio("n_ret", "n_lines"), F.col(fr.PLANTED)).alias("ratio")))


COUNTS = "SELECT coalesce(a.{c}, b.{c}) AS {c}, coalesce(a.n, 0) AS n_train, coalesce(b.n, 0) AS n_test FROM (SELECT {c}, count(*) AS n FROM train GROUP BY 1) a FULL JOIN (SELECT {c}, count(*) AS n FROM test GROUP BY 1) b ON a.{c} = b.{c}"


@query("pr13_value_counts", with_blocks(COUNTS.format(c="cohort_year"), "train", "test"))
def value_counts(spark, folder):
    return pr.value_counts(*sides(spark, folder), "cohort_year")


@query("pr14_cohort_drift", with_blocks(
    "SELECT cohort_year, n, round(mean, 6) AS mean, round(max(mean) OVER () - min(mean) OVER (), 6) AS drift FROM "
    "(SELECT cohort_year, count(*) AS n, avg(score) AS mean FROM train GROUP BY 1)", "train"))
def cohort_drift(spark, folder):
    return rounded(pr.cohort_drift(sides(spark, folder)[0], "cohort_year", fr.TARGET))


@query("pr15_share_shift", with_blocks(
    "SELECT cohort_year, round(a, 6) AS pct_train, round(b, 6) AS pct_test, round(abs(a - b), 6) AS abs_diff FROM (SELECT cohort_year, "
    "100.0 * n_train / sum(n_train) OVER () AS a, 100.0 * n_test / sum(n_test) OVER () AS b FROM c)", "train", "test", extra={"c": COUNTS.format(c="cohort_year")}))
def share_shift(spark, folder):
    return rounded(pr.share_shift(*sides(spark, folder), "cohort_year")).orderBy(F.desc("abs_diff"))


WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) > 0))"


@query("pr18_text_profile", with_blocks(
    f"SELECT lang, count(*) AS n, round(avg({WORDS}), 6) AS words_mean, CAST(min({WORDS}) AS INTEGER) AS words_min, CAST(max({WORDS}) AS INTEGER) AS words_max, "
    "round(avg(length(text)), 6) AS chars_mean, CAST(min(length(text)) AS INTEGER) AS chars_min, CAST(max(length(text)) AS INTEGER) AS chars_max, "
    "count(DISTINCT text) AS n_distinct, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS n_digit FROM documents GROUP BY lang"))
def text_profile(spark, folder):
    return rounded(pr.text_profile(fr.text_frame(spark, folder), "text", ["lang"]))


#: Stand-ins for the domain keywords in the languages of the given texts.
KEYWORDS = ("the", "ing", "und", "der", "les", "que", "erat", "zzzz")


@query("pr19_keyword_frequency", per_column(
    "SELECT '{c}' AS keyword, count(*) FILTER (WHERE contains(lower(replace(replace(text, 'I', 'ı'), 'İ', 'i')), '{c}')) AS n_rows FROM documents",
    [fold_case_py(k) for k in KEYWORDS]))
def keyword_frequency(spark, folder):
    return pr.keyword_frequency(fr.text_frame(spark, folder), "text", KEYWORDS)


@query("pr20_column_profile", with_blocks(
    "SELECT a.\"column\", role, n_missing_train, pct_missing_train, n_missing_test, pct_missing_test, nunique, corr FROM (" + per_column(
        "SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing_train, round(100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS pct_missing_train, count(DISTINCT {c}) AS nunique FROM train", ALL) +
    ") a JOIN (" + per_column("SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing_test, round(100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS pct_missing_test FROM test", ALL) +
    ") b USING (\"column\") LEFT JOIN (" + per_column("SELECT '{c}' AS \"column\", round(corr({c}, y2), 6) AS corr FROM train", [*NUM, *fr.YEARS]) +
    ") d USING (\"column\") JOIN (VALUES " + ", ".join(f"('{c}', '{ROLES[c]}')" for c in ALL) + ") AS m(\"column\", role) USING (\"column\")", "train", "test"))
def column_profile(spark, folder):
    train, test = sides(spark, folder)
    return rounded(pr.column_profile(train, test, {c: ROLES[c] for c in ALL}, [*NUM, *fr.YEARS], fr.PLANTED))


EXPECTED = [("mean", 54.0, 1.0), ("std_samp", 15.19, 0.05), ("max", 100.0, 0.0), ("pct_cap", 7.73, 1.0), ("median", 54.0, 2.0)]


@query("pr21_expectations", with_blocks(
    "SELECT e.label, round(CASE e.label WHEN 'mean' THEN mean WHEN 'std_samp' THEN std_samp WHEN 'max' THEN max WHEN 'pct_cap' THEN pct_cap ELSE median END, 6) AS value, ref, tol, "
    "CASE WHEN abs(CASE e.label WHEN 'mean' THEN mean WHEN 'std_samp' THEN std_samp WHEN 'max' THEN max WHEN 'pct_cap' THEN pct_cap ELSE median END - ref) <= tol THEN 'PASS' ELSE 'WARN' END AS status "
    "FROM m, (VALUES " + ", ".join(f"('{a}', CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for a, b, c in EXPECTED) + ") AS e(label, ref, tol)", "train", extra={"m": MOMENTS}))
def expectations(spark, folder):
    p = pr.target_profile(sides(spark, folder)[0], fr.TARGET)
    labels = [e[0] for e in EXPECTED]
    return rounded(pr.check_expectations(p.select(*labels).unpivot([], labels, "label", "value"), EXPECTED))


@query("pr23_ranges", with_blocks(
    per_column("SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, round(avg({c}), 6) AS mean, max({c}) <= 100.5 AND min({c}) >= -0.5 AND max({c}) > 10 AS score_like FROM train", NUM), "train"))
def ranges(spark, folder):
    return rounded(pr.ranges(sides(spark, folder)[0], NUM), keep=("lo", "hi"))


@query("pr24_segment_summary", with_blocks(
    "SELECT segment, status, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, count(*) AS n FROM train GROUP BY ALL", "train"))
def segment_summary(spark, folder):
    return rounded(pr.segment_summary(sides(spark, folder)[0], ["segment", "status"], fr.TARGET))


@query("pr25_rule_violations", with_blocks(
    "SELECT 'negative_count' AS rule, count(*) FILTER (WHERE n_lines < 0) AS n_violations FROM frame UNION ALL "
    "SELECT 'above_hundred', count(*) FILTER (WHERE score > 100) FROM frame UNION ALL "
    "SELECT 'returns_exceed_lines', count(*) FILTER (WHERE n_ret > n_lines) FROM frame UNION ALL "
    "SELECT 'ship_before_order_year', count(*) FILTER (WHERE ship_year < cohort_year) FROM frame UNION ALL "
    "SELECT 'negative_balance', count(*) FILTER (WHERE acctbal < 0) FROM frame", "frame"))
def rule_violations(spark, folder):
    return pr.rule_violations(fr.score_frame(spark, folder), {
        "negative_count": F.col("n_lines") < 0, "above_hundred": F.col("score") > 100,
        "returns_exceed_lines": F.col("n_ret") > F.col("n_lines"),
        "ship_before_order_year": F.col("ship_year") < F.col("cohort_year"), "negative_balance": F.col("acctbal") < 0})


SIGN = ["score", "y2", "n_lines", "avg_qty", "acctbal"]


@query("pr26_segment_signature", with_blocks(
    per_column("SELECT segment, count(*) AS n, '{c}' AS \"column\", round((avg({c}) - any_value(m)) / any_value(s), 6) AS z FROM train, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM train) GROUP BY segment", SIGN), "train"))
def segment_signature(spark, folder):
    return rounded(pr.segment_signature(sides(spark, folder)[0], "segment", SIGN))


@query("pr22_column_manifest")
def column_manifest(spark, folder):
    from ..operators.features import column_manifest as manifest

    train, _ = sides(spark, folder)
    return manifest(train)
