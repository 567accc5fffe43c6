"""Secrets: character Markov models of random strings and of ordinary identifiers.

Base spans come from three fixed patterns and always stay. Beyond them, tokens
of at least ``LEAST`` characters are scored by the log-likelihood ratio of two
first-order character models. The models are trained on labelled samples from
the corpus itself: values that the base patterns name as secrets, and ordinary
words (no digits) of texts without any. The threshold lies above nearly every
ordinary word of a held-out sample, by a margin, so that plain prose is left alone.

DataFrame functions only. The models hold one number per pair of symbols of a
fixed alphabet, whatever the corpus; texts are never shuffled.

Rows: null text counts as empty; results are per row, so null and repeated ids
and repeated rows keep their own rows. Other columns are ignored. With no
labelled secrets or no ordinary words the base spans stand alone.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import GAP, plain_text, stored
from foldwise.llm.spans import gated, joined, match_spans, ranked

KINDS = ["assign", "access", "hex", "random"]
#: Characters of a proposed token, at least.
LEAST = 20
#: Labelled strings of each class used for fitting, at most, chosen by hash.
SAMPLE = 20_000
#: Texts whose words may be drawn as ordinary samples, at most, chosen by hash.
SAMPLE_TEXTS = 20_000
#: The threshold is this quantile of the held-out ordinary ratios plus a margin, per character.
QUANTILE, MARGIN = 0.999, 0.3
#: Weight of a symbol's own frequency in its pairs.
BACK = 10.0
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(SYMBOLS) + 1  # 0: any other character, and the start

_NAME = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_HEAD = rf"""{_NAME}["']?\x20*+[:=]\x20*+["']?"""
PATTERNS = {
    "assign": _HEAD + r"[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
}
_TOKEN = "[A-Za-z0-9+/_=-]"
PROPOSAL = rf"(?<!{_TOKEN}){_TOKEN}{{{LEAST},}}+"


def _value(s: Column) -> Column:
    """The value of an assignment: what follows its head."""
    return F.regexp_replace(s, "^" + _HEAD, "")


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(match_spans(text, PATTERNS["assign"]), lambda s: F.length(_value(s["text"])) >= 12)
    return {
        "assign": gated(text.rlike("[:=]") & text.rlike(_HEAD), assign),
        "access": gated(F.contains(text, F.lit("AKIA")), match_spans(text, PATTERNS["access"])),
        "hex": gated(text.rlike(PATTERNS["hex"]), match_spans(text, PATTERNS["hex"])),
    }


def _codes(token: Column) -> Column:
    """Symbol numbers of a token, after a start symbol."""
    return F.transform(F.split(token, ""), lambda c: F.when(c == F.lit(""), 0).otherwise(F.instr(F.lit(SYMBOLS), c)))


def _pairs(token: Column) -> Column:
    """Numbers of the adjacent symbol pairs of a token."""
    codes = _codes(token)
    before = F.concat(F.array(F.lit(0)), codes)
    return F.zip_with(F.slice(before, F.lit(1), F.size(codes)), codes, lambda a, b: a * SIZE + b)


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """At most about ``most`` of the distinct tokens, by hash."""
    rows = stored(rows.select("token").distinct(), "tokens")
    n = rows.count()
    share = F.pmod(F.xxhash64(F.lit("draw"), "token"), F.lit(1_000_000))
    return rows.where(share < int(1_000_000 * min(1.0, most / max(n, 1)))).withColumn("held", F.pmod(F.xxhash64("token"), F.lit(4)) == 0)


def _log_model(tokens: DataFrame) -> dict[int, float]:
    """Smoothed log probabilities of a symbol after a symbol: SIZE * SIZE numbers at most.

    A pair falls back to the symbol's own frequency, so a symbol that a class
    hardly uses stays unlikely after any other.
    """
    counts = {r["pair"]: r["n"] for r in tokens.select(F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()}
    before, symbol = [0] * SIZE, [0] * SIZE
    for pair, n in counts.items():
        before[pair // SIZE] += n
        symbol[pair % SIZE] += n
    total = sum(symbol)
    own = [(n + 0.5) / (total + 0.5 * SIZE) for n in symbol]
    return {p: math.log((counts.get(p, 0) + BACK * own[p % SIZE]) / (before[p // SIZE] + BACK)) for p in range(SIZE * SIZE)}


def ratio(token: Column, weights: list[float]) -> Column:
    """Mean log-likelihood ratio per character, random over ordinary."""
    pairs = _pairs(token)
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # one literal, not thousands
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(table, p)) / F.greatest(F.size(pairs), F.lit(1))


def models(bases: DataFrame, rows: DataFrame) -> tuple[list[float], float] | None:
    """Pair weights and threshold, from labelled secrets and ordinary words.

    ``bases(values)`` has each text's base values, ``rows(doc_id, _t, values)``
    the texts; ordinary words come from texts without a base value.
    """
    secret = _drawn(bases.select(F.explode("values").alias("token")).where(F.length("token") >= 12), SAMPLE)
    plain = rows.where((F.size("values") == 0) & (F.length("_t") > 0))
    n = bases.count()
    share = F.pmod(F.xxhash64(F.lit("texts"), "_t"), F.lit(1_000_000))
    some = plain.where(share < int(1_000_000 * min(1.0, SAMPLE_TEXTS / max(n, 1))))
    words = some.select(F.explode(F.split("_t", GAP)).alias("token")).where(F.length("token").between(8, 200) & ~F.col("token").rlike("[0-9]"))
    ordinary = _drawn(words, SAMPLE)
    a, b = _log_model(secret.where("not held")), _log_model(ordinary.where("not held"))
    weights = [a[p] - b[p] for p in range(SIZE * SIZE)]
    top = ordinary.where("held").agg(F.percentile(ratio(F.col("token"), weights), F.lit(QUANTILE)).alias("top")).first()["top"]
    if top is None or not secret.limit(1).count():
        return None
    return weights, max(0.0, top) + MARGIN


def secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts of base spans, digest of the base, all spans.

    A scored token that lies inside a base span adds nothing.
    """
    a = docs.select("doc_id", plain_text(F.col("text").cast("string")).alias("_t"))
    found = base_spans(F.col("_t"))
    a = a.select("*", *[found[k].alias(f"_{k}") for k in KINDS[:3]])
    values = F.concat(F.transform("_assign", lambda s: _value(s["text"])), F.transform("_access", lambda s: s["text"]), F.transform("_hex", lambda s: s["text"]))
    token = gated(F.col("_t").rlike(PROPOSAL), match_spans(F.col("_t"), PROPOSAL))
    kept = stored(
        a.select(
            "doc_id",
            F.concat(*[ranked(F.col(f"_{k}"), i) for i, k in enumerate(KINDS[:3])]).alias("base"),
            values.alias("values"),
            F.filter(token, lambda s: s["text"].rlike("[0-9]") | s["text"].rlike("[a-z].*[A-Z]")).alias("tokens"),
        ),
        "secrets",
    )
    fitted = models(kept, a.select("_t", values.alias("values")))
    base = F.col("base")
    extra = F.filter(base, lambda s: F.lit(False))
    if fitted is not None:
        weights, threshold = fitted
        new = F.filter(
            "tokens",
            lambda s: (ratio(s["text"], weights) >= threshold) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])),
        )
        extra = ranked(new, 3)
    count = lambda i: F.size(F.filter(base, lambda s: s["rank"] == i)).cast("long")
    return kept.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.concat(base, extra), KINDS).alias("spans"),
    )
