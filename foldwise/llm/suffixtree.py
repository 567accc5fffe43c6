"""Language-model scores by a probabilistic suffix tree over words.

The root is the smoothed word distribution of the training texts. A context is
one or two words. What follows a context at least ``MIN_COUNT`` times is explicit;
a context is retained if the distribution of its explicit words diverges from that
of its parent (the context without its first word) by more than the description
length of its own parameters. A retained state gives

    P(w | s) = max(c(s, w) - DISCOUNT, 0) / c(s) + rest(s) * P(w | parent of s)

and a position is scored in its longest retained suffix; a suffix of a retained
context is retained. Every distribution sums to one.

Nothing of the model is gathered, however many contexts there are. Texts are dealt
into blocks of about ``BLOCK_TOKENS`` words. For each step a block sends its distinct
words, pairs or triples with their counts, packed, to buckets of keys; a bucket adds
up and answers every block in the order of the keys sent. One block owns each
explicit pair or triple and adds it to the sums of its context, which meet in the
same way. Steps: words, pairs, contexts of one word and triples (of explicit pairs
only), contexts of two words, suffixes, scores. Buckets grow with the words, blocks
with the texts; a long text is one block.

``train`` gathers a tree for callers that want one in memory; its size is bounded by ``p_min``.
``scores`` does not use it.

Rows: null text counts as empty and has the end token alone. A null id counts as
the empty string in the training split. Null and repeated ids and repeated rows
keep a row each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import stored
from foldwise.llm.wordscan import mix, scan_words
from foldwise.session import fresh_path

#: Times a word must follow a context to be explicit there, whatever the size of the corpus.
MIN_COUNT = 2.0
DISCOUNT = 0.5
FOLDS, HELD = 5, 1
#: The end of a text, as a word.
END = int(mix(np.array([0x656E64], np.uint64)).view(np.int64)[0])
BITS = 20
#: Words of a block of texts; keys of a bucket, about.
BLOCK_TOKENS, BUCKET_KEYS = 1 << 19, 1 << 20


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, token hashes with an end after each text, token offsets)``."""
    for first, last, words, at in scan_words(batch.column("text")):
        n = last - first
        tokens = np.full(len(words) + n, END, np.int64)
        place = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(at))
        tokens[place] = words.view(np.int64)
        yield first, tokens, at + np.arange(n + 1)


def _held(ids: pa.Array) -> np.ndarray:
    texts = ids.cast(pa.string()).to_pylist()
    return np.array([zlib.crc32((t or "").encode()) % FOLDS == HELD for t in texts], bool)


def _training(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pa.array(~_held(batch.column("doc_id"))))


def _tallied(keys: np.ndarray) -> pa.RecordBatch:
    key, n = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["w", "n"])


class Tables:
    """Frequent words, pairs and triples with their counts; at most 1 / p_min of each."""

    def __init__(self, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        empty = np.empty(0, np.int64)
        self.words, self.word_n, self.pairs, self.pair_n, self.triples, self.triple_n = (empty,) * 6

    def word_ids(self, tokens: np.ndarray) -> np.ndarray:
        return find(self.words, tokens)

    def pair_keys(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key of the pair that ends at each token, and whether there is one."""
        before = np.full(len(ids), -1, np.int64)
        before[1:] = ids[:-1]
        before[offsets[:-1]] = -1  # every text has a token
        return before << BITS | ids, (before >= 0) & (ids >= 0)

    def triple_keys(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        key, ok = self.pair_keys(ids, offsets)
        pair = np.where(ok, find(self.pairs, key), -1)
        context = np.full(len(ids), -1, np.int64)
        context[1:] = pair[:-1]
        context[offsets[:-1]] = -1
        return context << BITS | ids, (context >= 0) & (pair >= 0), context, pair


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def _gathered(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys that reach p_min of all tokens, sorted, with counts: at most 1 / p_min rows."""
    rows = counts.where(F.col("n") >= F.lit(least)).toPandas()
    w, n = rows["w"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    order = np.argsort(w)
    return w[order], n[order]


class Tree:
    """Retained contexts as arrays: explicit shares and rest weights of both levels."""

    def __init__(self, t: Tables):
        self.t = t
        root = np.log10((t.word_n + 0.5) / (t.total + 0.5 * (t.distinct + 1))) if len(t.words) else np.empty(0)
        self.root = 10.0**root
        self.log_root = root
        first, second = t.pairs >> BITS, t.pairs & ((1 << BITS) - 1)
        size = t.word_n.astype(float)
        self.share1, self.rest1, diverges1 = self._level(first, t.pair_n, size, self.root[second] if len(second) else np.empty(0))
        p1 = self.share1 + self.rest1[first] * self.root[second] if len(first) else np.empty(0)
        context, word = t.triples >> BITS, t.triples & ((1 << BITS) - 1)
        # The parent's probability of the word: the pair (second word of the context, word).
        parent = np.empty(0)
        if len(context):
            inner = find(t.pairs, second[context] << BITS | word)
            known = np.maximum(inner, 0)
            parent = np.where(inner >= 0, p1[known], self.rest1[second[context]] * self.root[word])
        self.share2, self.rest2, diverges2 = self._level(context, t.triple_n, t.pair_n.astype(float), parent)
        self.keep2 = diverges2
        self.keep1 = diverges1
        if len(second):  # a suffix of a retained context is retained
            self.keep1 = diverges1 | (np.bincount(second[diverges2], minlength=len(t.words)) > 0)

    def _level(self, context: np.ndarray, n: np.ndarray, size: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Discounted shares, rest weight of each context, and the divergence test."""
        k = len(size)
        own = np.bincount(context, minlength=k)
        explicit = np.bincount(context, weights=n, minlength=k)
        covered = np.bincount(context, weights=parent, minlength=k)
        share = (n - DISCOUNT) / size[context] if len(n) else np.empty(0)
        rest = 1.0 - np.bincount(context, weights=share, minlength=k)
        gain = np.bincount(context, weights=n * np.log(n / size[context] / parent) if len(n) else None, minlength=k).astype(float)
        left = size - explicit
        with np.errstate(divide="ignore", invalid="ignore"):
            gain += np.where(left > 0, left * np.log(left / size / np.maximum(1.0 - covered, 1e-12)), 0.0)
        keep = (own > 0) & (gain > 0.5 * own * math.log(max(self.t.total, 2)))
        return share, rest, keep

    def log_scores(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: place among the frequent words, root log10, and log10 in the longest state.

        For a rare word the root's part is left out of both.
        """
        t = self.t
        ids = t.word_ids(tokens)
        rare = ids < 0
        if not len(t.words):
            return ids, np.zeros(len(ids)), np.zeros(len(ids))
        p = np.where(rare, 1.0, self.root[ids])
        _, _, context, pair = t.triple_keys(ids, offsets)
        before = np.full(len(ids), -1, np.int64)
        before[1:] = ids[:-1]
        before[offsets[:-1]] = -1
        on = np.flatnonzero((before >= 0) & self.keep1[before])
        if len(on):
            s = np.where(pair[on] >= 0, self.share1[pair[on]], 0.0) if len(t.pairs) else 0.0
            p[on] = s + self.rest1[before[on]] * p[on]
        if len(t.pairs):
            on = np.flatnonzero((context >= 0) & self.keep2[context])
            if len(on):
                at = np.where(rare[on], -1, find(t.triples, context[on] << BITS | np.maximum(ids[on], 0)))
                s = np.where(at >= 0, self.share2[at], 0.0) if len(t.triples) else 0.0
                p[on] = s + self.rest2[context[on]] * p[on]
        return ids, np.where(rare, 0.0, self.log_root[ids]), np.log10(p)


def train(rows: DataFrame, p_min: float) -> tuple[Tree, DataFrame]:
    """The tree and the table of all training words ``(w, n)`` from ``rows(doc_id, text)``."""
    if p_min * (1 << BITS) < 1:
        raise ValueError("p_min must be at least 2 ** -20")
    spark = rows.sparkSession

    def singles(batches):
        for batch in batches:
            for _, tokens, _ in _sequences(_training(batch)):
                yield _tallied(tokens)

    words = stored(rows.mapInArrow(singles, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    tables = Tables(sums["total"], sums["distinct"])
    least = max(MIN_COUNT, p_min * tables.total)
    tables.words, tables.word_n = _gathered(words, least)

    shared = spark.sparkContext.broadcast(tables)

    def doubles(batches):
        for batch in batches:
            for _, tokens, offsets in _sequences(_training(batch)):
                key, ok = shared.value.pair_keys(shared.value.word_ids(tokens), offsets)
                yield _tallied(key[ok])

    tables.pairs, tables.pair_n = _gathered(rows.mapInArrow(doubles, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), least)
    longer = spark.sparkContext.broadcast(tables)

    def triples(batches):
        for batch in batches:
            for _, tokens, offsets in _sequences(_training(batch)):
                key, ok, _, _ = longer.value.triple_keys(longer.value.word_ids(tokens), offsets)
                yield _tallied(key[ok])

    tables.triples, tables.triple_n = _gathered(rows.mapInArrow(triples, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), least)
    return Tree(tables), words


WORDS, PAIRS, LEVEL1, TRIPLES, LEVEL2, SUFFIX, SCORE = range(7)
_U = np.uint64
_PAIR, _TRIPLE = _U(0xD1342543DE82EF95), _U(0xA0761D6478BD642F)


def _packed(a: np.ndarray) -> bytes:
    """Numbers by byte position, which the compression of shuffles and files makes use of."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(a.size, a.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and the number of each key given."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def _block(number: int, ids: list[pa.Array], held: list[np.ndarray], texts: list[np.ndarray], sizes: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    """One row: ids, split, lengths, distinct words (the most frequent first) and each token's place among them."""
    words, _, inverse = _distinct(np.concatenate(texts).view(np.uint64))
    order = np.argsort(-np.bincount(inverse), kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    tokens = pa.compress(_packed(place[inverse]), codec="zstd", asbytes=True)
    lengths, out = np.concatenate(sizes), np.concatenate(held)
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    columns = [
        pa.array([number], pa.int64()),
        one(pa.concat_arrays(ids).cast(kind)),
        one(pa.array(out)),
        one(pa.array(lengths, pa.int64())),
        pa.array([words[order].tobytes()], pa.binary()),
        pa.array([tokens], pa.binary()),
        pa.array([int(lengths[~out].sum())], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "held", "sizes", "words", "tokens", "n_train"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, kept, held_tokens, kind = TaskContext.get().partitionId() << 32, ([], [], [], []), 0, None
    for batch in batches:
        kind, held = batch.column("doc_id").type, _held(batch.column("doc_id"))
        for first, tokens, offsets in _sequences(batch):
            n = len(offsets) - 1
            for part, value in zip(kept, (batch.column("doc_id").slice(first, n), held[first : first + n], tokens, np.diff(offsets))):
                part.append(value)
            held_tokens += len(tokens)
            if held_tokens >= BLOCK_TOKENS:
                yield _block(number, *kept, kind)
                number, kept, held_tokens = number + 1, ([], [], [], []), 0
    if held_tokens:
        yield _block(number, *kept, kind)


class Block:
    """The texts of a block, and what the steps before have answered to it."""

    def __init__(self, row: pa.Table, back: pa.Table | None):
        value = lambda name: row.column(name)[0]
        words = np.frombuffer(value("words").as_py(), np.uint64)
        sizes = np.asarray(value("sizes").values)
        tokens = _unpacked(pa.decompress(value("tokens").as_py(), decompressed_size=4 * int(sizes.sum()), codec="zstd", asbytes=True), np.uint32)
        order = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words, self.tokens = words[order], place[tokens]
        self.ids, self.held, self.sizes = value("ids").values, np.asarray(value("held").values), sizes
        self.train = np.repeat(~self.held, sizes)
        self.starts = np.cumsum(sizes) - sizes
        self.first = np.zeros(len(tokens), bool)
        self.first[self.starts] = True
        self.answers: dict[int, list[tuple[int, bytes]]] = {}
        if back is not None:
            for step, bucket, data in zip(*(back.column(c).to_pylist() for c in ("step", "bucket", "data"))):
                self.answers.setdefault(step, []).append((bucket, data))

    def answer(self, step: int) -> np.ndarray:
        """A number for each key sent in the step, in the order of the keys."""
        parts = [_unpacked(data, np.float64) for _, data in sorted(self.answers.get(step, []))]
        return np.concatenate(parts) if parts else np.empty(0)

    def sent(self, step: int, total: int, distinct: int, least: float) -> dict[int, tuple[np.ndarray, np.ndarray]] | pa.Table:
        """Sorted distinct keys with the numbers to add up for each, by step; in the last step the scores."""
        words, tokens = self.words, self.tokens
        if step == WORDS:
            return {WORDS: (words, np.bincount(tokens[self.train], minlength=len(words))[None].astype(float))}
        count = self.answer(WORDS)
        often = count >= least
        root = (count + 0.5) / (total + 0.5 * (distinct + 1))
        follows = ~self.first
        follows[1:] &= often[tokens[:-1]]
        at = np.flatnonzero(follows & often[tokens])
        keys, one, inverse = _distinct(mix((words * _PAIR)[tokens[at - 1]] + words[tokens[at]]))
        if step == PAIRS:
            return {PAIRS: (keys, np.bincount(inverse, weights=self.train[at], minlength=len(keys))[None])}
        answer = self.answer(PAIRS)
        pair_n, owned = np.abs(answer), answer < 0
        before, word = tokens[at[one] - 1], tokens[at[one]]
        # The explicit pair that ends at each token, or -1.
        pair = np.full(len(tokens), -1)
        pair[at] = np.where(pair_n[inverse] > 0, inverse, -1)
        context = np.full(len(tokens), -1)
        context[1:] = pair[:-1]
        context[self.first] = -1
        explicit = np.flatnonzero(pair_n > 0)
        rest2 = np.zeros(len(keys))
        if step > LEVEL2:
            rest2[explicit] = self.answer(LEVEL2)
        keep2 = rest2 > 0
        if step == SUFFIX:
            return {SUFFIX: (words, (np.bincount(word[keep2], minlength=len(words)) > 0)[None].astype(float))}
        at3 = np.flatnonzero((context >= 0) & (pair >= 0))
        keys3, one3, inverse3 = _distinct(mix((keys * _TRIPLE)[context[at3]] + words[tokens[at3]]))
        if step == LEVEL1:
            triples = keys3, np.bincount(inverse3, weights=self.train[at3], minlength=len(keys3))[None]
            return {LEVEL1: (words, _explicit(before[owned], pair_n[owned], count, root[word[owned]])), TRIPLES: triples}
        answer = self.answer(LEVEL1)
        rest1, keep1 = np.where(answer == 0, 1.0, np.abs(answer)), answer > 0
        share1 = np.where(pair_n > 0, (pair_n - DISCOUNT) / count[before], 0.0)
        p1 = share1 + rest1[before] * root[word]
        answer = self.answer(TRIPLES)
        triple_n, owned = np.abs(answer), answer < 0
        before3, inner = context[at3[one3]], pair[at3[one3]]
        if step == LEVEL2:
            return {LEVEL2: (keys[explicit], _explicit(before3[owned], triple_n[owned], pair_n, p1[inner[owned]])[:, explicit])}
        keep1 |= self.answer(SUFFIX) > 0
        p = root[tokens]
        base = np.log10(p)
        on = np.flatnonzero(~self.first)
        on = on[keep1[tokens[on - 1]]]
        share = np.where(pair[on] >= 0, share1[pair[on]], 0.0) if len(keys) else 0.0
        p[on] = share + rest1[tokens[on - 1]] * p[on]
        triple = np.full(len(tokens), -1)
        triple[at3] = inverse3
        on = np.flatnonzero(context >= 0)
        on = on[keep2[context[on]]]
        if len(on):
            share2 = np.where(triple_n > 0, (triple_n - DISCOUNT) / pair_n[before3], 0.0) if len(keys3) else np.zeros(1)
            p[on] = np.where(triple[on] >= 0, share2[triple[on]], 0.0) + rest2[context[on]] * p[on]
        sums = lambda a: np.add.reduceat(a, self.starts)
        columns = [self.ids, pa.array(self.held), pa.array(self.sizes), pa.array(sums((count[tokens] > 0).astype(np.int64))), pa.array(sums(base)), pa.array(sums(np.log10(p)))]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _explicit(context: np.ndarray, n: np.ndarray, size: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """For each context: explicit words, their count, their parent's share and the divergence; and its size."""
    k = len(size)
    gain = n * np.log(n / size[context] / parent)
    return np.array([np.bincount(context, weights=x, minlength=k) for x in (np.ones(len(n)), n, parent, gain)] + [size])


def _rest(sums: np.ndarray, size: np.ndarray, total: int) -> np.ndarray:
    """Rest weight of each context: negative if not retained, 0 without explicit words."""
    own, explicit, covered, gain = sums[:4]
    left = size - explicit
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = 1.0 - (explicit - DISCOUNT * own) / size
        gain = gain + np.where(left > 0, left * np.log(left / size / np.maximum(1.0 - covered, 1e-12)), 0.0)
    return np.where(own > 0, np.where(gain > 0.5 * own * math.log(max(total, 2)), rest, -rest), 0.0)


def _rows(block: int, step: int, keys: np.ndarray, parts: np.ndarray, bits: int) -> pa.Table:
    """A row for each bucket: the keys that begin with its bits, as differences, and their numbers."""
    bucket = (keys >> _U(64 - bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1], cuts[1:]))
    columns = [
        pa.array([block] * len(spans), pa.int64()),
        pa.array([step] * len(spans), pa.int32()),
        pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
        pa.array([_packed(np.diff(keys[a:b], prepend=_U(0))) for a, b in spans], pa.binary()),
        pa.array([_packed(parts[:, a:b].ravel()) for a, b in spans], pa.binary()),
    ]
    return pa.Table.from_arrays(columns, names=["block", "step", "bucket", "keys", "parts"])


def _meet(rows: pa.Table, total: int, least: float) -> pa.Table:
    """The answers of a bucket: each key's sum, or what follows from it, to every block that sent the key."""
    rows, step = rows.sort_by("block"), rows.column("step")[0].as_py()
    sent = [np.cumsum(_unpacked(k, np.uint64), dtype=np.uint64) for k in rows.column("keys").to_pylist()]
    ends = np.cumsum([len(k) for k in sent])
    parts = np.concatenate([_unpacked(p, np.float64).reshape(-1, len(k)) for p, k in zip(rows.column("parts").to_pylist(), sent)], axis=1)
    keys, first, inverse = _distinct(np.concatenate(sent))
    sums = np.array([np.bincount(inverse, weights=p, minlength=len(keys)) for p in parts])
    if step in (LEVEL1, LEVEL2):
        answer = _rest(sums, parts[4][first], total)[inverse]
    elif step in (PAIRS, TRIPLES):
        answer = np.where(sums[0] >= least, sums[0], 0.0)[inverse]
        answer[first] *= -1  # one of the blocks that have the key owns it
    else:
        answer = sums[0][inverse]
    fresh = np.diff(np.searchsorted(np.sort(first[sums[0] > 0]), ends), prepend=0)
    columns = [
        rows.column("block"),
        rows.column("step"),
        rows.column("bucket"),
        pa.array([_packed(answer[b - len(k) : b]) for b, k in zip(ends, sent)], pa.binary()),
        pa.array(fresh, pa.int64()),
    ]
    return pa.Table.from_arrays(columns, names=["block", "step", "bucket", "data", "fresh"])


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """Written to the shared folder in buckets of the key: a step then moves its answers to the blocks, not the blocks."""
    spark, name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", fresh_path(spark, name)).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved here; the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def scores(docs: DataFrame, p_min: float = 0.0) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts, the root's score and the tree's score, in log10.

    ``p_min`` asks more of explicit words: at least that share of all training tokens.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(
        _blocks, f"block long, ids array<{kind}>, held array<boolean>, sizes array<long>, words binary, tokens binary, n_train long"
    )
    blocks = _bucketed(dealt, "block")
    seen = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("tokens")).first()
    total, bits = seen["total"], max(3, math.ceil(math.log2(max(seen["tokens"], 1) / BUCKET_KEYS)))
    least, distinct = max(MIN_COUNT, p_min * total), 0
    answers: DataFrame | None = None

    def taken(step: int, schema: str) -> DataFrame:
        known = (total, distinct, least)

        def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
            out = Block(left, right).sent(step, *known)
            number = left.column("block")[0].as_py()
            return out if step == SCORE else pa.concat_tables([_rows(number, k, *keyed, bits) for k, keyed in out.items()])

        if answers is None:
            return blocks.groupBy("block").applyInArrow(lambda left: run(left), schema)
        needed = answers.where(F.col("step").isin(WORDS, PAIRS, LEVEL2)) if step == SUFFIX else answers
        return blocks.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(lambda left, right: run(left, right), schema)

    def met(step: int) -> DataFrame:
        sent = taken(step, "block long, step int, bucket long, keys binary, parts binary")
        return sent.groupBy("step", "bucket").applyInArrow(lambda rows: _meet(rows, total, least), "block long, step int, bucket long, data binary, fresh long")

    for step in (WORDS, PAIRS, LEVEL1, LEVEL2, SUFFIX):  # the triples go with the contexts of one word
        found = stored(met(step), f"step{step}")
        if step == WORDS:
            distinct = found.agg(F.coalesce(F.sum("fresh"), F.lit(0)).alias("n")).first()["n"]
        answers = found if answers is None else answers.unionAll(found)
    out = taken(SCORE, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
