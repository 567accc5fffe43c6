"""Personal data: generators propose spans, boosted trees and calibrated thresholds select.

Base spans come from four fixed patterns with validators and always stay. High-
recall generators propose further, overlapping spans (obfuscated addresses,
numbers in free formats). Every proposal is described by format and context
features; gradient-boosted trees learn from the proposals that the validators
decide, and a proposal becomes a redaction when its calibrated precision on held-out
documents reaches ``PRECISION``.

All of it is DataFrame functions and Spark's own boosted trees; only proposals,
never texts, are written or shuffled.

Rows: null text counts as empty. Results are per row, so null and repeated ids
and repeated rows each keep their own row. Other columns are ignored, except by
``redacted``, which passes them through whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import hinted, plain_text, quoted, stored
from foldwise.llm.spans import gated, joined, match_spans, ranked

KINDS = ["email", "ip", "card", "phone"]
#: Proposals used for fitting, about, shared by the kinds; documents are chosen by hash, not by place. All others calibrate.
FIT_ROWS = 40_000
PRECISION = 0.95
#: Held-out proposals that must lie at or above a threshold before it may be used.
LEAST_HELD = 30
TREES, TREE_DEPTH = 8, 3

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole runs of digits with single separators, of 14 to 19 digits.
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall proposals: kind, pattern.
GENERATORS = [
    ("email", r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,24}+"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:[.,][0-9]{1,3}+){3}+(?![0-9.])"),
    ("card", r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){12,20}+(?![0-9])"),
    ("phone", r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20()./-]{0,2}[0-9]){6,15}+(?![0-9])"),
]
CONTEXT = 24
WORDS = {
    "says_phone": r"(?i)phone|tel\b|tel[.:]|call|fax|mobil",
    "says_card": r"(?i)card|visa|credit|amex|master",
    "says_ip": r"(?i)\bip\b|host|server|address",
    "says_mail": r"(?i)mail|contact|write to",
}


def luhn(digits: Column) -> Column:
    """Luhn checksum of a digit string."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, twice - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.coalesce(value(i), F.lit(0))) % 10 == 0)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[.,]|$)){4}$"


def base_spans(text: Column) -> dict[str, Column]:
    """Validated base spans of each kind."""
    digit = text.rlike("[0-9]")
    checks = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["text"].rlike(_OCTETS),
        "card": lambda s: luhn(_digits(s["text"])),
        "phone": lambda s: F.length(_digits(s["text"])).between(10, 15),
    }
    gates = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")) & digit}
    out = {}
    for kind in KINDS:
        spans = match_spans(text, PATTERNS[kind])
        out[kind] = gated(gates[kind], spans if kind == "email" else F.filter(spans, checks[kind]))
    return out


def _base(rows: DataFrame) -> DataFrame:
    """Adds ``_t`` (text) and ``base`` (sortable spans of all kinds) to ``rows(..., text)``."""
    rest = [c for c in rows.columns if c != "text"]
    a = rows.select(*rest, plain_text("text").alias("_t"))
    found = base_spans(F.col("_t"))
    a = a.select("*", *[ranked(found[k], i).alias(f"_{k}") for i, k in enumerate(KINDS)])
    return a.withColumn("base", F.concat(*[F.col(f"_{k}") for k in KINDS])).drop(*[f"_{k}" for k in KINDS])


def proposals(rows: DataFrame) -> DataFrame:
    """``(key, rank, start, end, label, features...)`` of the generators' spans in ``rows(key, _t, base)``."""
    text = F.col("_t")
    some = text.rlike("[0-9@]|\\x20at\\x20|\\(at\\)|\\[at\\]")
    parts = [_with_rank(gated(some, match_spans(text, pattern)), KINDS.index(kind)) for kind, pattern in GENERATORS]
    a = rows.where(some).select("key", text, "base", F.explode(F.concat(*parts)).alias("p"))
    start, end = F.col("p.start"), F.col("p.end")
    before = F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)).cast("int"), F.least(start, F.lit(CONTEXT)).cast("int"))
    after = F.substring(text, (end + 1).cast("int"), F.lit(1))
    own = F.col("p.text")
    digits = _digits(own)
    same = F.exists("base", lambda b: (b["rank"] == F.col("p.rank")) & (b["start"] < end) & (b["end"] > start))
    flag = lambda c: c.cast("double")
    features = {
        "rank": F.col("p.rank").cast("double"),
        "n_digits": F.length(digits).cast("double"),
        "n_chars": F.length(own).cast("double"),
        "n_groups": F.size(F.split(own, "[^0-9A-Za-z]+")).cast("double"),
        "n_spaces": (F.length(own) - F.length(F.replace(own, F.lit(" "), F.lit("")))).cast("double"),
        "n_dots": (F.length(own) - F.length(F.replace(own, F.lit("."), F.lit("")))).cast("double"),
        "n_dashes": (F.length(own) - F.length(F.replace(own, F.lit("-"), F.lit("")))).cast("double"),
        "plus": flag(own.startswith("+")),
        "at_sign": flag(F.contains(own, F.lit("@"))),
        "luhn": flag(luhn(digits)),
        "octets": flag(own.rlike(_OCTETS)),
        "glued_before": flag(before.rlike("[0-9A-Za-z]$")),
        "glued_after": flag(after.rlike("[0-9A-Za-z]")),
        **{k: flag(before.rlike(v)) for k, v in WORDS.items()},
    }
    return a.select(
        "key", F.col("p.rank").alias("rank_no"), start.alias("start"), end.alias("end"), same.cast("double").alias("label"), *[v.alias(k) for k, v in features.items()]
    )


def _with_rank(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))


FEATURES = ["rank", "n_digits", "n_chars", "n_groups", "n_spaces", "n_dots", "n_dashes", "plus", "at_sign", "luhn", "octets", "glued_before", "glued_after", *WORDS]


def most_fit(kinds: list) -> float:
    """Proposals of a kind in the fitting sample at most: what rare kinds leave of FIT_ROWS is the others'."""
    left = float(FIT_ROWS)
    for k, n in enumerate(sorted(r["n"] for r in kinds)):
        if n > left / (len(kinds) - k):
            return left / (len(kinds) - k)
        left -= n
    return float(FIT_ROWS)


def selected(candidates: DataFrame) -> DataFrame:
    """``(key, spans)``: proposals beyond the base whose calibrated precision suffices.

    ``candidates`` is a stored table. Of two thirds of the documents, as many as a
    kind's share of FIT_ROWS needs train the trees with their proposals of that
    kind. Every other proposal calibrates: per kind, the lowest score from which
    on at least LEAST_HELD of all of them are right in PRECISION of the cases.
    """
    none = candidates.where(F.lit(False)).select("key", F.array(F.struct("start", F.col("rank_no").alias("rank"), "end")).alias("extra"))
    kinds = candidates.groupBy("rank_no").agg(F.count("*").alias("n"), F.sum("label").alias("y")).collect()  # four rows at most
    total, right = sum(r["n"] for r in kinds), sum(r["y"] for r in kinds)
    if not 0 < right < total:
        return none
    # A document trains or calibrates with all its proposals of one kind.
    fold = F.pmod(F.xxhash64(F.lit("fold"), "key"), F.lit(3))
    share = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1_000_000))
    bound = F.lit(0)
    for r in kinds:
        bound = F.when(F.col("rank_no") == r["rank_no"], int(1_000_000 * min(1.0, most_fit(kinds) / r["n"]))).otherwise(bound)
    trains = (fold > 0) & (share < bound)
    sample = stored(candidates.where(trains), "sample")
    counts = sample.agg(F.count("*").alias("n"), F.sum("label").alias("y")).first()
    if not counts["n"] or not 0 < counts["y"] < counts["n"]:
        return none
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, maxBins=32, seed=7)
    model = trees.fit(vectors.transform(sample).coalesce(2))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 3)

    def scored(rows: DataFrame) -> DataFrame:
        return model.transform(vectors.transform(rows)).withColumn("score", score)

    # At most 1,001 scores a kind.
    held = scored(candidates.where(~trains)).groupBy("rank_no", "score").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    bars = held.groupBy("rank_no").agg(F.collect_list(F.struct("score", "n", "y")).alias("bars"))
    steps = bars.select("rank_no", "bars", F.explode("bars.score").alias("cut"))
    up = F.filter("bars", lambda b: b["score"] >= F.col("cut"))
    n = F.aggregate(up, F.lit(0.0), lambda s, b: s + b["n"])
    y = F.aggregate(up, F.lit(0.0), lambda s, b: s + b["y"])
    cuts = steps.select("rank_no", "cut", n.alias("n"), y.alias("y")).where((F.col("n") >= LEAST_HELD) & (F.col("y") >= PRECISION * F.col("n")))
    chosen = {r["rank_no"]: r["cut"] for r in cuts.groupBy("rank_no").agg(F.min("cut").alias("cut")).collect()}  # four rows at most
    if not chosen:
        return none
    passes = reduce(lambda a, b: a | b, [(F.col("rank_no") == k) & (F.col("score") >= v) for k, v in chosen.items()])
    span = F.struct("start", F.col("rank_no").alias("rank"), "end")
    return scored(candidates.where("label = 0")).where(passes).groupBy("key").agg(F.collect_set(span).alias("extra"))


def _key(docs: DataFrame) -> Column:
    """Same id and text: same key and same spans."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("id"), F.xxhash64("_t").alias("h"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts of base spans, digest of the base, all spans."""
    rows = _base(docs.select("doc_id", F.col("text").cast("string").alias("text"))).withColumn("key", _key(docs))
    candidates = stored(proposals(rows).distinct(), "proposals")
    extra = stored(selected(candidates), "selected")
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    slim = rows.select("doc_id", "key", "base")
    both = slim.join(hinted(extra, 100_000), "key", "left")
    everything = F.array_union("base", F.coalesce("extra", F.filter("base", lambda s: F.lit(False))))
    return both.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(everything, KINDS).alias("spans"),
    )


def _masked(text: Column, spans: Column) -> Column:
    """The text with every (possibly overlapping) span replaced by ``[KIND]``."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        piece = F.when(fresh, F.concat(gap, F.get(names, s["rank"]))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(F.sort_array(spans), start, step, rest)).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars`` brought up to date, if present."""
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _base(rows).withColumn("key", _key(docs))
    extra = stored(selected(stored(proposals(rows.select("key", "_t", "base")).distinct(), "proposals")), "selected")
    # Only ids and spans are joined; most texts have none and bypass the join.
    some = F.col("_t").rlike("[0-9@]|\\x20at\\x20|\\(at\\)|\\[at\\]")
    hit = rows.where(some).join(hinted(extra, 100_000), "key", "left")
    spans = F.array_union("base", F.coalesce("extra", F.filter("base", lambda s: F.lit(False))))
    clean = hit.select("row", _masked(F.col("_t"), spans).alias("new")).unionByName(rows.where(~some).select("row", F.col("row.text").alias("new")))
    text = F.when(F.col("row.text").isNotNull(), F.col("new"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            changed = F.coalesce(text != F.col("row.text"), F.lit(False))
            out.append(F.when(changed, F.length(text).cast(dict(docs.dtypes)[c])).otherwise(F.col("row.n_chars")).alias(c))
        else:
            out.append(F.col(f"row.{quoted([c])[0]}").alias(c))
    return clean.select(*out)
