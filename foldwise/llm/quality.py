"""Quality rules with risk-controlled cutoffs, by DataFrame functions only.

Base rules are fixed (word count, repeated words).  On top of them each measured
ratio may have a cutoff per stratum (language).  A cutoff is used only if
labelled good documents certify it: for every (stratum, ratio, cutoff) the exact
binomial test of "at least ``risk`` of the good documents lie above the cutoff"
must be rejected at ``level`` divided by the number of tests (Bonferroni), with
``risk`` the total risk divided by the number of ratios.  The strictest
certified cutoff of each stratum and ratio is taken, so that with probability
``1 - level`` no stratum loses more than the total risk of its good documents.

Rows: null text counts as empty (fails the base rules). A null language is the
stratum ``unknown``; strata without enough labels get no cutoff and lose
nothing beyond the base rules. Null or repeated ids are judged row by row;
repeated labels of an id count as good only if all of them are. Extra columns
pass through ``keep_good`` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import hinted, NOT_GAP, plain_text, quoted, stored, word_array

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: Largest share of good documents that all cutoffs of a stratum may reject, and the chance of breaking that.
TOTAL_RISK, LEVEL = 0.02, 0.05
#: Cutoffs tried for each ratio, lax to strict.
GRIDS: dict[str, list[float]] = {
    "symbol_ratio": [round(0.8 * 0.8**k, 6) for k in range(20)],
    "dup_line_ratio": [round(0.95 - 0.045 * k, 6) for k in range(20)],
    "repeat_ratio": [round(0.3 - 0.014 * k, 6) for k in range(20)],
    "mean_word": [round(40.0 * 0.9**k, 6) for k in range(20)],
}
RATIOS = list(GRIDS)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _paired(h: Column, size: Column, step: int) -> Column:
    """Hashes of every item with the item ``step`` later."""
    return F.zip_with(F.slice(h, F.lit(1), size - step), F.slice(h, F.lit(1 + step), size - step), lambda a, b: F.xxhash64(a, b))


def measured(rows: DataFrame) -> DataFrame:
    """Counts and ratios of ``rows(..., text)`` as a struct ``m``; all built-in expressions.

    A window of eight words is one hash built by three doublings; windows are
    sorted with their places only in texts that repeat one, so the work stays
    n log n in the words of a text.
    """
    keep = [c for c in rows.columns if c != "text"]
    text = F.col("_t")
    a = rows.select(*keep, plain_text("text").alias("_t"))
    a = a.select(*keep, "_t", word_array(text).alias("_w"), F.filter(F.split(text, "\n"), lambda s: s.rlike(NOT_GAP)).alias("_l"))
    a = a.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= WINDOW, F.transform("_w", lambda w: F.xxhash64(w))).alias("_h"),
    )
    rest = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    for step in (1, 2, 4):
        a = a.select(*rest, _paired(F.col("_h"), F.size("_h"), step).alias("_h"))
    a = a.select(*rest, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    at = F.col("_s")

    def place(k: Column) -> Column:
        own = F.get(at, k)
        again = (F.get(at, k - 1)["h"] == own["h"]) | (F.get(at, k + 1)["h"] == own["h"])
        return F.when(again, own["i"])

    spots = F.transform(F.sequence(F.lit(0), F.size("_s") - 1), place)
    a = a.select(*rest, F.when(at.isNotNull(), F.sort_array(F.array_compact(spots))).alias("_p"))
    p, n = F.col("_p"), F.size("_p")
    steps = F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), lambda x, y: F.least(F.lit(WINDOW), y - x).cast("long"))
    covered = F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda s, x: s + x)
    a = a.select(*rest, F.when(p.isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))
    over = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return a.select(
        *keep,
        F.struct(
            *COUNTS,
            over("n_symbols", "word_chars").alias("symbol_ratio"),
            over("n_dup_lines", "n_lines").alias("dup_line_ratio"),
            over("n_repeat_words", "n_words").alias("repeat_ratio"),
            over("word_chars", "n_words").alias("mean_word"),
            failed.alias("base_failed"),
        ).alias("m"),
    )


def _log_factorial(x: Column) -> Column:
    """ln x!, by table below ten and Stirling's series above."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)])
    z = x.cast("double") + 1.0
    series = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
    return F.when(x < 10, F.get(small, x.cast("int"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p) for k below the mean; 1 from the mean on.

    Summed down from k: the terms fall geometrically, and 50,000 of them pass
    the last digit for any n this side of 10^13.
    """
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * (k - i + 1) / (n - k + i) * odds
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    total = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(k, F.lit(50_000)).cast("long")), start, add, lambda s: s["total"])).otherwise(F.lit(1.0))
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(top) * total)).otherwise(F.lit(1.0))


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label calls good."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def _passed(value: Column, grid: list[float]) -> Column:
    """How many cutoffs of a grid lie below the value."""
    return F.size(F.filter(F.lit(grid), lambda c: c < value))


def cutoffs(measures: DataFrame, labels: DataFrame, total_risk: float = TOTAL_RISK, level: float = LEVEL) -> DataFrame:
    """``stratum`` and the certified cutoff of each ratio (null: none), from ``measures(doc_id, stratum, m)``."""
    risk = total_risk / len(RATIOS)
    held = measures.join(good_ids(labels), "doc_id").where(~F.col("m.base_failed"))
    above = [F.struct(F.lit(r).alias("ratio"), _passed(F.col(f"m.{r}"), GRIDS[r]).alias("passed")) for r in RATIOS]
    counts = held.select("stratum", F.explode(F.array(*above)).alias("x")).groupBy("stratum", "x.ratio", "x.passed").agg(F.count("*").alias("n"))
    # At most one row for each cutoff and one more in every list.
    groups = counts.groupBy("stratum", "ratio").agg(F.sum("n").alias("n"), F.collect_list(F.struct("passed", "n")).alias("bars"))
    bars = F.col("bars")
    grid = F.create_map(*[x for r in RATIOS for x in (F.lit(r), F.lit(GRIDS[r]))])
    size = F.size(F.element_at(grid, F.col("ratio")))
    tests = groups.select("stratum", "ratio", "n", "bars", size.alias("size"), F.posexplode(F.element_at(grid, F.col("ratio"))).alias("turn", "cutoff"))
    # Cutoffs fall along the grid: a value above ``passed`` of them is above the last ``passed``.
    rejected = F.aggregate(F.filter(bars, lambda b: b["passed"] + F.col("turn") >= F.col("size")), F.lit(0).cast("long"), lambda s, b: s + b["n"])
    tests = tests.select("stratum", "ratio", "cutoff", "n", rejected.alias("k"))
    tests = stored(tests.withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk)), "tests")
    n_tests = tests.count()
    picked = tests.where(F.col("p") * F.lit(n_tests) <= F.lit(level))
    return picked.groupBy("stratum").agg(*[F.min(F.when(F.col("ratio") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RATIOS])


def with_verdict(measures: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``verdict`` to rows with ``stratum`` and ``m``. The cutoff table has a row per stratum."""
    beyond = [F.coalesce(F.col(f"m.{r}") > F.col(f"cut_{r}"), F.lit(False)) for r in RATIOS]
    bad = beyond[0]
    for b in beyond[1:]:
        bad = bad | b
    joined = measures.join(hinted(cuts, 50_000), "stratum", "left")
    return joined.withColumn("verdict", ~F.col("m.base_failed") & ~bad).drop(*[f"cut_{r}" for r in RATIOS])


def _strata(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("unknown")) if "lang" in docs.columns else F.lit("unknown")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang)``: counts, base verdict and final verdict."""
    rows = docs.select("doc_id", _strata(docs).alias("stratum"), F.col("text").cast("string").alias("text"))
    m = stored(measured(rows), "measures")
    out = with_verdict(m, stored(cutoffs(m, labels), "cutoffs"))
    return out.select("doc_id", *[F.col(f"m.{c}") for c in COUNTS], "m.base_failed", F.col("verdict").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Measures are stored as a few numbers a row. The verdict depends on text and
    stratum only, so rows are dropped by id and a hash of both: the dropped keys
    are broadcast when counted small, else texts are shuffled once.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("key_id"), F.xxhash64(F.col("text").cast("string"), _strata(docs)).alias("key_hash")]
    rows = docs.select("doc_id", *key, _strata(docs).alias("stratum"), F.col("text").cast("string").alias("text"))
    m = stored(measured(rows), "measures")
    judged = with_verdict(m, stored(cutoffs(m, labels), "cutoffs"))
    dropped = stored(judged.where("not verdict").select("key_id", "key_hash").distinct(), "dropped")
    return docs.select(F.struct(*quoted(docs.columns)).alias("row"), *key).join(hinted(dropped), ["key_id", "key_hash"], "left_anti").select("row.*")
