"""Text in long form: (row, term, tf), vocabularies, TF-IDF weights and lexicon features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import textexpr as tx

MIN_DF = 3
MAX_FEATURES = 20_000


@dataclass(frozen=True)
class TermSpace:
    """One family of terms: analyzer, n-gram lengths, frequency floor and size."""

    name: str
    analyzer: str
    lo: int
    hi: int
    min_df: int = MIN_DF
    max_features: int = MAX_FEATURES

    def exploded(self, folded: DataFrame, key: str) -> DataFrame:
        """(key, term), one row per occurrence, from a folded text column ``_t``.

        Tokens get their own projection so that they are extracted once per row.
        """
        if self.analyzer == "word":
            tokens = folded.select(key, tx.words("_t", lx.STOPWORDS).alias("_w"))
            return tokens.select(key, F.explode(tx.word_ngrams("_w", self.lo, self.hi)).alias("term"))
        return folded.select(key, F.explode(tx.char_ngrams("_t", self.lo, self.hi)).alias("term"))


WORD = TermSpace("w", "word", 1, 2)
CHAR = TermSpace("c", "char_wb", 3, 5)
RICH_WORD = TermSpace("w", "word", 1, 3, 2, 80_000)
RICH_CHAR = TermSpace("c", "char_wb", 2, 6, 2, 80_000)
#: The character ablation keeps the word default lengths (1, 2).
CHAR_SHORT = TermSpace("c", "char_wb", 1, 2)


def term_counts(df: DataFrame, text: str, space: TermSpace, key: str = "row_id", prefix: bool = False) -> DataFrame:
    """(key, term, tf); the namespace prefix keeps word and character terms apart.

    Texts are dealt by key before they are cut up, so that the counts need no shuffle of their terms.
    """
    tokens = space.exploded(df.select(key, tx.fold_case(text).alias("_t")).repartition(key), key)
    if prefix:
        tokens = tokens.withColumn("term", F.concat(F.lit(f"{space.name}:"), "term"))
    return tokens.groupBy(key, "term").agg(F.count("*").alias("tf"))


def union_counts(df: DataFrame, text: str, spaces: Sequence[TermSpace], key: str = "row_id") -> DataFrame:
    """Counts of several term families in one table."""
    parts = [term_counts(df, text, s, key, prefix=True) for s in spaces]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vocabulary(counts: DataFrame, n_docs: Column, min_df: int = MIN_DF, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, df, total_tf, idf) of the most frequent terms; at most ``max_features`` rows."""
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf")).filter(F.col("df") >= min_df)
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return stats.orderBy(F.col("total_tf").desc(), "term").limit(max_features).select("term", "df", "total_tf", idf.alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame, key: str = "row_id") -> DataFrame:
    """Sublinear tf times idf, each row scaled to unit length.

    The vocabulary is bounded by ``max_features``, so it is broadcast; the length is
    a window over one document's terms.
    """
    raw = counts.join(F.broadcast(vocab.select("term", "idf")), "term").select(
        key, "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("w"))


@dataclass(frozen=True)
class Lexicon:
    positive: Sequence[str] = lx.POSITIVE
    negative: Sequence[str] = lx.NEGATIVE
    skill: Sequence[str] = lx.SKILL
    contrast: str = lx.CONTRAST


HANDCRAFTED = (
    "n_pos", "n_neg", "pos_minus_neg", "has_contrast", "len_word", "len_char",
    "n_sentence", "n_skill_mention", "pos_ratio", "neg_ratio",
)


def handcrafted(df: DataFrame, text: str, lexicon: Lexicon = Lexicon(), key: str = "row_id") -> DataFrame:
    """Ten fixed lexicon and structure features per row."""
    base = df.select(key, tx.fold_case(text).alias("_t")).select(
        key,
        tx.count_terms("_t", lexicon.positive).alias("n_pos"), tx.count_terms("_t", lexicon.negative).alias("n_neg"),
        F.col("_t").contains(tx.fold_case_py(lexicon.contrast)).cast("int").alias("has_contrast"),
        tx.word_count("_t").alias("len_word"), F.length("_t").alias("len_char"),
        F.greatest(F.lit(1), F.regexp_count("_t", F.lit(r"\."))).alias("n_sentence"),
        tx.count_terms("_t", lexicon.skill).alias("n_skill_mention"),
    )
    n_words = F.col("len_word") + 1.0
    return base.select(
        key, "n_pos", "n_neg", (F.col("n_pos") - F.col("n_neg")).alias("pos_minus_neg"), "has_contrast", "len_word",
        "len_char", "n_sentence", "n_skill_mention", (F.col("n_pos") / n_words).alias("pos_ratio"), (F.col("n_neg") / n_words).alias("neg_ratio"))


def digit_gate(df: DataFrame, text: str) -> DataFrame:
    """Rows with digits; the gate is open only when there are none."""
    n = F.sum(tx.has_digit(text).cast("long"))
    return df.agg(F.count("*").alias("n_rows"), n.alias("n_digit"), (n == 0).alias("clean"))


def pattern_flags(df: DataFrame, text: str, patterns: Mapping[str, str], score: str, pivot: float, key: str = "row_id") -> DataFrame:
    """0/1 per pattern plus its product with 'score above the pivot'."""
    low = df.select(key, score, tx.fold_case(text).alias("_t"))
    flags = low.select(key, score, *[F.col("_t").rlike(p).cast("int").alias(n) for n, p in patterns.items()])
    return flags.select(key, *patterns, *[(F.col(n) * (F.col(score) > pivot).cast("int")).alias(f"{n}_high") for n in patterns])


def distinctive_terms(counts: DataFrame, low_rows: DataFrame, top: int, min_df: int = MIN_DF, key: str = "row_id") -> DataFrame:
    """Terms typical of the low tail by smoothed log-odds of their occurrence counts."""
    marked = counts.join(low_rows.select(key, F.lit(1).alias("_low")), key, "left")
    is_low = F.col("_low").isNotNull()
    per_term = marked.groupBy("term").agg(
        F.count("*").alias("df"), F.sum(F.when(is_low, F.col("tf")).otherwise(0)).alias("low"),
        F.sum(F.when(is_low, 0).otherwise(F.col("tf"))).alias("rest")).filter(F.col("df") >= min_df)
    t = per_term.agg(F.struct(F.sum("low").alias("l"), F.sum("rest").alias("r"), F.count("*").alias("v"))).scalar()
    odds = F.log((F.col("low") + 1.0) / (t["l"] + t["v"])) - F.log((F.col("rest") + 1.0) / (t["r"] + t["v"]))
    return per_term.select("term", "low", "rest", F.round(odds, 6).alias("log_odds")).orderBy(F.col("log_odds").desc(), "term").limit(top)


def vector_hygiene(df: DataFrame, vector: str, dim: int, tol: float = 1e-3) -> DataFrame:
    """Counts of vectors with a wrong size, non-finite parts or a length off one."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.agg(
        F.count("*").alias("n_rows"), F.sum((F.size(v) != dim).cast("long")).alias("n_wrong_dim"),
        F.sum((~finite).cast("long")).alias("n_not_finite"),
        F.sum((finite & (F.abs(norm - 1.0) > tol)).cast("long")).alias("n_not_unit"), F.avg(norm).alias("mean_norm"))
