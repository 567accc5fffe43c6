"""Source divergence, hard negatives and source mixing against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import divergence, mining, mixing, queries
from foldwise.llm.common import stored

CLASH = "key int, rank int, gid int, value long, n long, terms string, at string, x int, `odd.name` string"


def clashing(df):
    """The same rows with columns that clash with names the operators use."""
    for i, c in enumerate(("key", "rank", "gid", "value", "n", "terms", "at", "x", "odd.name", "e", "p", "none", "id", "slot", "words")):
        df = df.withColumn(c, F.lit(i))
    return df


# source divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, top=200, least=3):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    seen, here, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text or ""))
        groups.add((lang, source))
        seen[lang].update(set(terms))
        here[lang, source].update(terms)
    out = set()
    for lang, source in groups:
        kept = {t for t, n in seen[lang].items() if n >= least}
        of = lambda s: {t: here[lang, s][t] for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        mine, p = of(source), share(of(source))
        f = lambda p, q: (p - q) ** 2 // q
        pairs = []
        for _, other in [g for g in groups if g[0] == lang and g[1] != source]:
            q = share(of(other))
            pairs.append((other, sum(f(p[t], q[t]) for t in kept)))
        whole = Counter()
        for _, s in [g for g in groups if g[0] == lang]:
            whole.update(of(s))
        q = share({t: whole[t] for t in kept})
        terms = [(t, f(p[t], q[t])) for t in kept if mine[t] > 0 and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top}
    return out


def audit_rows():
    rng = random.Random(5)
    words = ["alpha", "Alpha", "alphabet", "alp", "al", "abcd", "abcde", "abcdefgh", "abcdefghi", "x" * 300, "x" * 301, "été", "étés", "日本", "日本語", "naïve", "o'clock", "3d", "_x_", "Ünder"]
    rows = [(None, "en", "a"), ("", "en", "b"), ("123 ,;", "en", "lonely"), (" \n ", "xx", "only"), ("solo words here", "yy", "one"), ("a\0b", None, None), (None, None, None)]
    for lang in ("en", "fr", None):
        for i in range(60):
            rows.append((" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), lang, rng.choice(["a", "b", "c", "", None, "é"])))
    rows += [("same words again same", "en", "a")] * 4
    rows.append((" ".join(rng.choice(words) + "z" * rng.randint(0, 3) for _ in range(60_000)), "en", "a"))
    return rows


def audit_frame(spark, rows):
    return clashing(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string"))


def test_audit_matches_plain_python(spark):
    rows = audit_rows()
    got = {tuple(r) for r in divergence.audit(audit_frame(spark, rows)).collect()}
    assert got == plain_audit(rows)


def test_audit_with_many_sources_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "MOST_SOURCES", 0)
    rows = [(f"alpha {'beta ' * (i % 4)} gamma{i % 5} abcdefghi{i % 3}", "en", f"s{i % 7}") for i in range(60)]
    got = {tuple(r) for r in divergence.audit(audit_frame(spark, rows), top=3).collect()}
    assert got == plain_audit(rows, top=3)


def test_crowded_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST_BITS", 64)
    monkeypatch.setattr(divergence, "MOST_BITS", 64)
    rows = audit_rows()
    got = {tuple(r) for r in divergence.audit(audit_frame(spark, rows)).collect()}
    assert got == plain_audit(rows)


def test_audit_with_joined_totals(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_GROUPS", 0)
    rows = audit_rows()
    got = {tuple(r) for r in divergence.audit(audit_frame(spark, rows)).collect()}
    assert got == plain_audit(rows)


def test_audit_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 300)
    monkeypatch.setattr(divergence, "FAN_IN", 4)
    rows = audit_rows()
    got = {tuple(r) for r in divergence.audit(audit_frame(spark, rows)).collect()}
    assert got == plain_audit(rows)


def test_shares_beyond_64_bits_are_exact():
    n, whole = np.array([0, 5, 10**13]), np.array([10**14] * 3)
    assert divergence._exact_share(n, whole).tolist() == [1 + 10**9 * (int(x) + 1) // 10**14 for x in n]


def test_audit_of_nothing(spark):
    assert divergence.audit(audit_frame(spark, [])).count() == 0
    got = {tuple(r) for r in divergence.audit(audit_frame(spark, [("rare words", "en", "a"), (None, "en", "b")])).collect()}
    assert got == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_rare_long_strings_leave_before_their_end(spark):
    """No level holds a prefix that fewer than three documents share."""
    rng = random.Random(8)
    docs = [(f"common {''.join(rng.choice('abcdefgh') for _ in range(40))}", "en", "a") for _ in range(50)]
    postings = stored(audit_frame(spark, docs).select("lang", "source", "text").mapInArrow(divergence._postings, divergence.POSTINGS), "postings")
    assert [tuple(r) for r in divergence.kept_terms(postings).select("lang", "term").collect()] == [("en", "common")]


# hard negatives


def plain_negatives(rows, every=50, positives=5, negatives=3, low=50, high=95):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [max(-mining.LIMIT, min(mining.LIMIT, math.floor(256.0 * x) if abs(x) < 1e12 else (1 << 60) * (1 if x > 0 else -1))) for x in v]
        kept[i] = min(kept.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in kept.items():
        if a % every:
            continue
        scores = sorted((-dot(q, w), i, other == label) for i, (other, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scores if x[2]][:positives]:
            found = [(i, -n) for n, i, same in scores if not same and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a, p, k + 1, i, -s, n) for k, (i, n) in enumerate(found)]
    return Counter(out)


def vector_rows(n=400, d=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=d) + 0.8], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, rows[i % 3][1], 1) for i in range(60)]  # equal vectors: ties by id
    rows += [(2000, None, 1), (2050, [1.0] * d, None), (None, [1.0] * d, 1), (2100, [float("nan")] + [0.0] * (d - 1), 1), (2150, [None] + [0.0] * (d - 1), 1)]
    rows += [(2200, [0.0] * d, 2), (2250, [1.0, 2.0], 2), (2300, [], 2), (-50, [-1.0] * d, 3), (2350, [3e4, -3e38, 1.0], 3), (2400, [float("inf")] * d, 1)]
    rows += [(50, rows[50][1], rows[50][2]), (100, [5.0] * d, 0), (100, [4.0] * d, 0)]  # repeated ids
    return rows


def vector_frame(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


@pytest.mark.parametrize("block", [16_384, 32])
def test_hard_negatives_match_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(mining, "BLOCK", block)
    rows = vector_rows()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    df = mining.hard_negatives(vector_frame(spark, rows))
    assert Counter(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == plain_negatives(rows)


def test_hard_negatives_of_other_windows(spark):
    rows = vector_rows(300, 4, 3)[:300]
    df = mining.hard_negatives(vector_frame(spark, rows), every=20, positives=7, negatives=2, low=10, high=120)
    assert Counter(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == plain_negatives(rows, 20, 7, 2, 10, 120)


def test_positives_are_sought_among_the_anchors_own_label_only(monkeypatch):
    """A meeting scores pairs of equal labels only, and ties go to the smaller id; an anchor does not meet itself."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    kind = pa.struct([("id", pa.int64()), ("label", pa.int64()), ("q", pa.list_(pa.int32()))])
    rows = [{"id": int(i), "label": int(i % 6), "q": rng.integers(-2, 3, 3).tolist()} for i in rng.permutation(600)]
    anchors = rows[:40] + [{"id": 9000, "label": 77, "q": [1, 1, 1]}]
    scored, plain = [], mining._scores
    monkeypatch.setattr(mining, "_scores", lambda a, b: (scored.append(len(a) * len(b)), plain(a, b))[1])
    batch = pa.RecordBatch.from_arrays([pa.array([x], pa.list_(kind)) for x in (anchors, rows)], names=["anchors", "rows"])
    got = {}
    for out in mining._near_same(iter([batch]), 4):
        for r in out.to_pylist():
            got.setdefault(r["anchor_id"], set()).add((r["id"], r["score"]))
    assert sum(scored) == 40 * 100
    for a in anchors[:-1]:
        near = sorted((-sum(x * y for x, y in zip(a["q"], r["q"])), r["id"]) for r in rows if r["label"] == a["label"] and r["id"] != a["id"])
        assert got.pop(a["id"]) == {(i, -s) for s, i in near[:4]}
    assert not got


def test_hard_negatives_of_little(spark):
    assert mining.hard_negatives(vector_frame(spark, [])).count() == 0
    assert mining.hard_negatives(vector_frame(spark, [(50, [1.0], 1)])).count() == 0
    assert mining.hard_negatives(vector_frame(spark, [(50, [1.0], 1), (51, [1.0], 1)])).count() == 0


# mixing


def plain_targets(words, weights=(3, 1, 2), share=150, most=2):
    """Shares by weight, again and again until no source is above its limit."""
    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, sum(words.values()) * share / 100, set(names)
    while open_:
        step = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if step[s] >= most * words[s]}
        if not full:
            return target | step
        for s in full:
            target[s] = most * words[s]
            left -= target[s]
        open_ -= full
    return target


def mix_rows(n=600, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * max(1, int(rng.lognormvariate(4, 1.2)))), rng.choice(["a"] * 8 + ["b", "c", "d", "é", "", None])) for i in range(n)]
    rows += [(5000, None, "a"), (5001, " \n", "a"), (5002, "", None), (None, "no id here", "b"), (5003, "twice " * 30, "c"), (5003, "twice " * 30, "c"), (5004, None, "wordless"), (5005, "word " * 50_000, "d")]
    return rows


def mix_frame(spark, rows):
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def by_source(rows, got):
    source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    taken = Counter()
    for r in got:
        taken[source[r.doc_id, r["size"]]] += r.taken
    return taken


def test_mix_meets_its_targets(spark):
    rows = mix_rows()
    words = Counter()
    for _, t, s in rows:
        words[s] += len((t or "").split())
    want = plain_targets(words)
    got = mixing.mix(mix_frame(spark, rows)).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == words[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        assert r.copies in (math.floor(r.target / max(1, r.source_size)), math.floor(r.target / max(1, r.source_size)) + 1)
    taken = by_source(rows, got)
    for s in words:
        if s != "d":  # one document of 50,000 words beside some hundreds
            assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s])


def test_mix_is_the_same_in_any_order(spark):
    rows = mix_rows(200)
    one = mixing.mix(mix_frame(spark, rows)).collect()
    two = mixing.mix(mix_frame(spark, rows[::-1]).repartition(5)).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))


def test_mix_of_little(spark):
    assert mixing.mix(mix_frame(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mix(mix_frame(spark, [(1, None, "a"), (2, " ", None)])).select("size", "target", "taken").collect()] == [(0, 0.0, 0)] * 2


def test_ranking_follows_pareto_odds(spark):
    """The taken documents are those of least (u/(1-u)) / (p/(1-p)), but for the one that closes the gap."""
    rows = [(i, "w " * (20 + i % 7), "a" if i % 3 else "b") for i in range(900)]
    got = mixing.mix(mix_frame(spark, rows))
    text = {i: t for i, t, _ in rows}
    from hashlib import md5

    for s in ("a", "b"):
        ranked = []
        for r in got.collect():
            if ("a" if r.doc_id % 3 else "b") == s and r.inclusion > 0:
                u = (int(md5(f"{r.doc_id}/{text[r.doc_id]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append((u / (1 - u) / (r.inclusion / (1 - r.inclusion)), r.copies - math.floor(r.target / r.source_size)))
        ranked.sort()
        n = sum(x for _, x in ranked)
        assert sum(x for _, x in ranked[:n]) >= n - 1


def test_priorities_set_inclusion_probabilities(spark):
    """Over many draws a document is taken as often as its expected copies say."""
    n, draws = 300, 60
    rows = [(k * n + i, "w " * 10, f"s{k:02d}") for k in range(draws) for i in range(n)]
    df = mix_frame(spark, rows)
    weight = (F.col("doc_id") % n % 3 + 1).cast("double")
    got = mixing.mix(df, weights=(1,), share=50, priority=weight).collect()
    taken, expected = Counter(), {}
    for r in got:
        taken[r.doc_id % n % 3] += r.copies
        expected[r.doc_id % n % 3] = r.inclusion
    total = draws * n // 3
    assert math.isclose(expected[1] / expected[0], 2.0, rel_tol=1e-6) and math.isclose(expected[2] / expected[0], 3.0, rel_tol=1e-6)
    for k, p in expected.items():
        assert abs(taken[k] / total - p) < 0.02
    assert sum(taken.values()) == draws * n // 2


def test_priorities_stop_at_most_copies(spark):
    rows = [(i, "w " * 10, "a") for i in range(100)]
    got = mixing.mix(mix_frame(spark, rows), priority=F.when(F.col("doc_id") < 50, F.lit(100.0)).when(F.col("doc_id") < 90, F.lit(1.0))).collect()
    copies = {r.doc_id: r.copies for r in got}
    assert all(copies[i] == 2 for i in range(50)) and all(copies[i] == 0 for i in range(90, 100))
    assert sum(copies.values()) == 150


def test_registered_queries_have_integer_ids(spark, folder):
    for name, col in (("op12_hard_negatives", "anchor_id"), ("op13_source_mixing", "doc_id")):
        assert dict(queries.QUERIES[name](spark, folder).dtypes)[col] == "bigint"
