"""Text expressions: case folding, tokens, n-grams, lexicon counts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rowwise import add_all, col

#: A word is a maximal run of at least two letters, digits or underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def fold_case(text: str | Column) -> Column:
    """Lower case with the dotted and dotless I kept apart; NULL becomes ''."""
    return F.lower(F.translate(F.coalesce(col(text), F.lit("")), "Iİ", "ıi"))


def fold_case_py(text: str) -> str:
    """The same folding for driver-side constants."""
    return text.translate(str.maketrans("Iİ", "ıi")).lower()


def words(text: str | Column, stop: Sequence[str] = ()) -> Column:
    tokens = F.regexp_extract_all(col(text), F.lit(WORD_PATTERN), F.lit(0))
    if not stop:
        return tokens
    return F.filter(tokens, lambda w: ~w.isin(list(stop)))


def word_ngrams(tokens: str, lo: int, hi: int) -> Column:
    """All word n-grams of length lo..hi of a token column, joined by one blank.

    Shifted copies of the array are zipped, so the cost is linear in its length.
    """
    tok = F.col(tokens)

    def of_length(n: int) -> Column:
        count = F.greatest(F.size(tok) - (n - 1), F.lit(0))
        grams = F.slice(tok, F.lit(1), count)
        for shift in range(1, n):
            grams = F.zip_with(grams, F.slice(tok, F.lit(shift + 1), count), lambda a, b: F.concat(a, F.lit(" "), b))
        return grams

    parts = [of_length(n) if n > 1 else tok for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def char_ngrams(text: str | Column, lo: int, hi: int) -> Column:
    """Character n-grams inside blank-padded words.

    A padded word shorter than ``lo`` yields itself once; longer sizes than the
    word are skipped.
    """
    padded = F.transform(
        F.filter(F.split(col(text), r"\s+"), lambda w: F.length(w) > 0),
        lambda w: F.concat(F.lit(" "), w, F.lit(" ")),
    )

    def grams_of(w: Column) -> Column:
        size = F.length(w)
        by_length = F.transform(
            F.sequence(F.lit(lo), F.greatest(F.lit(lo), F.least(F.lit(hi), size))),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)),
                lambda i: F.substring(w, i, n),
            ),
        )
        return F.flatten(by_length)

    return F.flatten(F.transform(padded, grams_of))


def count_terms(text: str | Column, terms: Sequence[str]) -> Column:
    """Non-overlapping substring occurrences summed over the (folded) terms."""
    return add_all(
        [F.regexp_count(col(text), F.lit(re.escape(fold_case_py(t)))) for t in terms]
    )


def word_count(text: str | Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda w: F.length(w) > 0))


def has_digit(text: str | Column) -> Column:
    return col(text).rlike("[0-9]")
