"""Positions of regular-expression matches in whole texts, by built-in functions.

``split`` gives the gaps between leftmost, non-overlapping matches and
``regexp_extract_all`` the matches; their running lengths are the positions in
code points. The patterns use possessive repeats and look-behinds, so that a
long run of characters is read once instead of once for each of its places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,text:string>>"


def match_spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, text>>`` of the matches, in order; end is exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).cast("long").alias("g"), m.alias("m")))
    empty = F.from_json(F.lit("[]"), SPAN)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["g"]
        end = start + F.length(x["m"]).cast("long")
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text")))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step, lambda a: a["out"])


def gated(condition: Column, spans: Column) -> Column:
    """The spans where the condition holds, else none: texts without the mark are not searched."""
    return F.when(condition, spans).otherwise(F.from_json(F.lit("[]"), SPAN))


def ranked(spans: Column, rank: int) -> Column:
    """Spans as sortable ``(start, rank of the kind, end)``."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")
