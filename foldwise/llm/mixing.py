"""Mixing sources to target weights by Pareto order sampling.

Sources in code point order, null last, take the weights in turn and share a given
part of all words; a target stops at ``most`` times its source's words, and what is
above is shared again by weight until nothing is. A document is expected in the mix
``e = target / words of its source`` times, or, with a priority, in proportion to it. The
whole part of ``e`` is certain; the rest ``p`` is left to chance: documents are ranked by
``(u / (1 - u)) / (p / (1 - p))``, their random odds divided by their inclusion
odds, and the first of a source are taken. The sample's size is fixed in words: the ranking
is followed while the words fit, and one more document closes the gap if any of
the others brings the sum nearer.

Shape of the work: one pass over the texts; from then on a row is a few numbers.
Running sums along the rankings are taken over range buckets (``operators.ranks``), so a
source that holds a third of all rows is spread like any other; only sums per source
meet, never a source's rows. Sources are numbered by a range sort. Built-in functions only.

Random numbers are digests of document id and text: reruns agree, whatever the order of
rows. Rows: a null or blank text has size 0 and ``taken`` 0. A null source is a
source of its own. Rows that repeat id and text share their random number, and are taken or left
together. Null ids are allowed. Other columns are ignored. Sources without words have target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.keyed import text_key, text_key_sql
from foldwise.llm.common import NOT_GAP, hinted, plain_text, stored
from foldwise.operators.ranks import cumulative

WEIGHTS = (3, 1, 2)
#: Part of all words that the mix holds, in hundredths, and times a document may be taken.
SHARE, MOST = 150, 2

SOURCE = ["none", "source"]
BITS = 52


def _numbered(sources: DataFrame) -> DataFrame:
    """``place``, from 0, in the order of (none, source): a range sort and the sizes of its parts."""
    order = stored(sources.orderBy(*SOURCE).withColumn("_at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = order.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return order.withColumn("_part", part).join(hinted(starts), "_part").withColumn("place", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """``none, source, words, target`` of ``sizes(none, source, words)``, one row per source.

    Sources reach their limit in the order of limit / weight; those before a point
    are at their limit, and the others share the rest by weight.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(_numbered(sizes).select(*SOURCE, "words", weight.alias("weight"), (F.col("words") * most).alias("limit")).withColumn("ratio", F.col("limit") / F.col("weight")), "sources")
    whole, heavy = rows.agg(F.sum("words"), F.sum("weight")).first()
    if not whole:
        return rows.select(*SOURCE, "words", F.lit(0.0).alias("target"))
    goal = whole * share / 100
    along = cumulative(rows, "ratio", (), {"limit": F.col("limit"), "weight": F.col("weight")})
    # What is left before a ratio's sources, and the weight that shares it.
    rest, light = F.lit(goal) - (F.col("cum_limit") - F.col("limit")), F.lit(heavy) - (F.col("cum_weight") - F.col("weight"))
    last = along.where(F.col("ratio") * light <= rest).agg(F.max("ratio"), F.max("cum_limit"), F.max("cum_weight")).first()
    ratio, used, gone = last if last[0] is not None else (-1.0, 0, 0.0)
    shared = F.col("weight") * F.lit(float(goal - used)) / F.lit(float(heavy - gone)) if heavy > gone else F.col("limit").cast("double")
    return rows.select(*SOURCE, "words", F.when(F.col("ratio") <= ratio, F.col("limit").cast("double")).otherwise(shared).alias("target"))


def _expected(rows: DataFrame, by_source: DataFrame, most: int) -> DataFrame:
    """``e`` of every row: priority in proportion, at most ``most``, so that the source's words meet the target."""
    usable = rows.where("size > 0 and priority > 0").withColumn("turn", F.lit(float(most)) / F.col("priority"))
    along = cumulative(usable, "turn", SOURCE, {"limit": F.col("size") * most, "lean": F.col("size") * F.col("priority")})
    along = along.join(hinted(by_source), SOURCE)
    rest, light = F.col("target") - (F.col("cum_limit") - F.col("limit")), F.col("total_lean") - (F.col("cum_lean") - F.col("lean"))
    full = F.col("turn") * light <= rest
    ends = stored(
        along.groupBy(*SOURCE).agg(F.max(F.when(full, F.col("turn"))).alias("turn"), F.max(F.when(full, F.col("cum_limit"))).alias("used"), F.max(F.when(full, F.col("cum_lean"))).alias("gone"), F.max("total_lean").alias("lean"), F.max("target").alias("goal")),
        "ends",
    )
    left = F.col("lean") - F.coalesce("gone", F.lit(0.0))
    step = ends.select(*SOURCE, F.col("turn").alias("full"), F.when(left > 0, (F.col("goal") - F.coalesce("used", F.lit(0))) / left).alias("step"))
    e = F.when(F.lit(float(most)) / F.col("priority") <= F.col("full"), F.lit(float(most))).otherwise(F.least(F.coalesce(F.col("priority") * F.col("step"), F.lit(0.0)), F.lit(float(most))))
    return rows.join(hinted(step), SOURCE, "left").withColumn("e", F.when((F.col("size") > 0) & (F.col("priority") > 0), e).otherwise(0.0)).drop("full", "step")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: int = SHARE, most: int = MOST, priority: Column | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, inclusion`` of every row of ``docs(doc_id, text, source)``.

    ``priority`` (a positive number; null or less counts as 0, never taken) makes
    some documents likelier than others of their source.
    """
    text = plain_text(F.col("text").cast("string"))
    identity = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), text)
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
            F.regexp_count(text, F.lit(NOT_GAP + "+")).cast("long").alias("size"), text_key(identity).alias("draw"),
            F.greatest(F.coalesce(priority, F.lit(0.0)), F.lit(0.0)).cast("double").alias("priority") if priority is not None else F.lit(1.0).alias("priority"),
        ),
        "sizes",
    )
    by_source = stored(targets(rows.groupBy(*SOURCE).agg(F.sum("size").alias("words")), weights, share, most), "targets")
    if priority is None:
        asked = rows.join(hinted(by_source), SOURCE).withColumn("e", F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0))
    else:
        asked = _expected(rows, by_source.select(*SOURCE, "target"), most).join(hinted(by_source), SOURCE)
    p, u = F.col("e") - F.floor("e"), (F.col("draw") + F.lit(0.5)) / F.lit(float(1 << BITS))
    asked = asked.withColumn("whole", F.floor("e")).withColumn("p", p).withColumn("odds", F.when((F.col("p") > 0) & (F.col("size") > 0), u * (1 - F.col("p")) / ((1 - u) * F.col("p"))))

    # Words left to chance in each source, and the ranking's running sums.
    left = asked.groupBy(*SOURCE).agg(F.max("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("sure")).select(*SOURCE, (F.col("target") - F.col("sure")).alias("room"))
    left = stored(left, "room")
    along = stored(cumulative(asked.select(*SOURCE, "odds", "size"), "odds", SOURCE, {"n": F.col("size")}).select(*SOURCE, "odds", "n", "cum_n"), "along")
    run = along.join(hinted(left), SOURCE)
    fits = F.col("cum_n") <= F.col("room")
    cut = stored(run.groupBy(*SOURCE).agg(F.coalesce(F.max(F.when(fits, F.col("odds"))), F.lit(-1.0)).alias("cut"), (F.max("room") - F.coalesce(F.max(F.when(fits, F.col("cum_n"))), F.lit(0))).alias("gap")), "cut")
    off = F.abs(F.col("gap") - F.col("n"))
    closing = (
        along.join(hinted(cut), SOURCE).where((F.col("odds") > F.col("cut")) & (off < F.col("gap")))
        .groupBy(*SOURCE).agg(F.min(F.struct(off.alias("off"), "odds")).alias("x")).select(*SOURCE, F.col("x.odds").alias("closing"))
    )
    ends = stored(cut.select(*SOURCE, "cut").join(closing, SOURCE, "left"), "ends")
    drawn = F.coalesce((F.col("odds") <= F.col("cut")) | (F.col("odds") == F.col("closing")), F.col("odds") <= F.col("cut"), F.lit(False))
    copies = F.col("whole") + drawn.cast("long")
    return asked.join(hinted(ends), SOURCE, "left").select(
        "doc_id", "size", F.col("words").alias("source_size"), "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "p"
    ).withColumnRenamed("p", "inclusion")


ORACLE = f"""
WITH docs AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    {text_key_sql("coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')")} AS draw FROM documents),
sources AS (
  SELECT none, source, sum(size)::BIGINT AS words, [{", ".join(f"{w}.0" for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY none, source) - 1) % {len(WEIGHTS)}]::DOUBLE AS weight FROM docs GROUP BY none, source),
ordered AS (
  SELECT *, {MOST} * words / weight AS ratio, sum(words) OVER () * {SHARE}.0::DOUBLE / 100 AS goal, sum(weight) OVER () AS heavy FROM sources),
along AS (
  SELECT *, coalesce(sum({MOST} * words) OVER w, 0)::BIGINT AS used, coalesce(sum(weight) OVER w, 0.0) AS gone FROM ordered
  WINDOW w AS (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tested AS (
  SELECT *, ratio * (heavy - (gone - sum(weight) OVER (PARTITION BY ratio))) <= goal - (used - sum({MOST} * words) OVER (PARTITION BY ratio)) AS at_limit FROM along),
point AS (SELECT coalesce(max(used) FILTER (at_limit), 0)::DOUBLE AS used, coalesce(max(gone) FILTER (at_limit), 0.0) AS gone FROM tested),
target AS (
  SELECT none, source, words, CASE WHEN goal = 0 THEN 0.0 WHEN at_limit THEN ({MOST} * words)::DOUBLE ELSE weight * (goal - point.used) / (heavy - point.gone) END::DOUBLE AS target FROM tested, point),
asked AS (
  SELECT docs.*, words, target, CASE WHEN words > 0 THEN target / words ELSE 0.0 END AS e, (draw + 0.5) / {float(1 << BITS)}::DOUBLE AS u
  FROM docs JOIN target USING (none, source)),
ranked AS (
  SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p, CASE WHEN e > floor(e) AND size > 0 THEN u * (1 - (e - floor(e))) / ((1 - u) * (e - floor(e))) END AS odds FROM asked),
steps AS (
  SELECT *, sum(CASE WHEN odds IS NOT NULL THEN size END) OVER (PARTITION BY none, source ORDER BY odds NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
    sum(size) OVER (PARTITION BY none, source, odds) AS tied, target - sum(whole * size) OVER (PARTITION BY none, source) AS room FROM ranked),
gaps AS (SELECT *, room - coalesce(max(run) FILTER (odds IS NOT NULL AND run <= room) OVER (PARTITION BY none, source), 0) AS gap FROM steps),
closing AS (
  SELECT none, source, arg_min(odds, (abs(gap - tied), odds)) AS closing FROM gaps WHERE odds IS NOT NULL AND run > room AND abs(gap - tied) < gap GROUP BY ALL)
SELECT doc_id, size, words AS source_size, target, copies * size AS taken, copies, p AS inclusion FROM (
  SELECT *, whole + CASE WHEN odds IS NOT NULL AND (run <= room OR odds = closing) THEN 1 ELSE 0 END AS copies
  FROM gaps LEFT JOIN closing USING (none, source))
"""
