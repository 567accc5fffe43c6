"""MinHash near-dedup: chosen-path set similarity join over word shingles.

Every document is a set of word shingles. Each of a number of independent trees
branches the documents by a selected minwise token: documents with the same
token share a node. A node that holds few documents is compared exhaustively, a
larger one branches again by further tokens. Trees are repeated until a pair at
the threshold meets in a leaf with the target probability.

Shape of the work:

* one pass over the texts gives a sketch of about 250 bytes a document;
* documents with equal sets become one node of the graph at once;
* a node first links each member only to a leader (the star passes); confirmed
  links make components, and from then on only pairs *across* components are of
  interest, so a group of copies never expands into pairs;
* leaves are bounded lists; a node whose members outside its main component would
  fill one list is compared as these against blocks of the main component, every
  other larger node branches, however dense it is;
* what no token splits in ``DEPTH`` levels is compared in blocks (it takes many
  documents at a similarity just below the threshold, all in each other's reach);
* every candidate is confirmed on the full shingle sets; those of a leaf in a bundle, where a document is one
  row with its text however many partners it has, and a bundle gives one link a document.

Rows: a null or blank text has an empty set, which links with nothing. Rows
without ``doc_id`` take no part. Rows that repeat a ``doc_id`` are versions of
one document: any of them may link it and the largest set is reported. Other
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import hinted, stored
from foldwise.llm.graph import components
from foldwise.llm.wordscan import mix, scan_words

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
#: Chance that a pair at the threshold is missed by all roots.
MISS = 1e-6
#: Minwise tokens per document; the estimate of a pair at 0.75 falls below SCREEN once in 10,000.
TOKENS, SCREEN = 256, 0.65
#: Nodes up to this many documents are compared exhaustively.
LEAF = 64
#: Members of one block of a longer list; nodes with at most so many blocks outside the main component are compared
#: as these against each other and the blocks of the main component, which copies a member a few times at most.
BLOCK, OTHERS = 256, 4
#: Star passes before the exhaustive one.
STARS = 2
#: Children of a larger node; 2 keeps a pair at 0.75 alive at every level (2 * 0.75 > 1).
BRANCH = 2
#: Levels before a node that no token splits is compared in blocks.
DEPTH = 8

_U = np.uint64


def tree_count(miss: float = MISS, threshold: float = NUMERATOR / DENOMINATOR) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    return (seeds[:n] >> _U(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> _U(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first row, sorted distinct shingle hashes of each row)`` in row order."""
    for first, _, words, at in scan_words(column):
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled = rolled * _U(0xD1342543DE82EF95) + words[k : k + n]
        rolled = mix(rolled)
        sets = []
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= width:
                sets.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:  # fewer words: the whole sequence is one shingle
                one = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        one = one * _U(0xA0761D6478BD642F) + w
                sets.append(mix(np.array([one])))
            else:
                sets.append(np.empty(0, np.uint64))
        yield first, sets


def _sketches(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    mult, plus = _coefficients(TOKENS + trees)
    for batch in batches:
        ids = batch.column(0)
        for first, sets in shingle_sets(batch.column(1)):
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            tokens = np.zeros((len(sets), TOKENS + trees), np.uint32)
            one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                one[full] = np.add.reduceat(mix(flat + _U(1)), starts)
                two[full] = np.add.reduceat(mix(flat ^ _U(0xE7037ED1A0B428DB)), starts)
                low = (flat >> _U(20)).astype(np.uint32)
                for j in range(TOKENS + trees):
                    tokens[full, j] = np.minimum.reduceat(low * mult[j] + plus[j], starts)
            # A short mix before the low byte is taken: minima of large sets are small numbers.
            low_bytes = (mix(tokens[:, trees:].astype(np.uint64)) >> _U(56)).astype(np.uint8)
            roots = (np.arange(trees, dtype=np.int64) << 32) | tokens[:, :trees].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, len(sets)),
                    pa.array(sizes, pa.int64()),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(0, roots.size + 1, trees, dtype=np.int32), pa.array(roots.ravel())),
                    pa.array([row.tobytes() for row in low_bytes], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "roots", "tokens"],
            )


def sketches(docs: DataFrame, trees: int) -> DataFrame:
    """Set size, set digest, root tokens and byte-wide minwise tokens of each document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda it: _sketches(it, trees), "doc_id long, n_shingles long, d1 long, d2 long, roots array<long>, tokens binary"
    )


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of equal minwise tokens of each pair."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, TOKENS) for i in (2, 3))
        share = (a == b).mean(axis=1) if len(a) else np.empty(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], names=["a", "b", "share"])


def _leaf_bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each leaf with their partners: those in other components that may reach the threshold.

    A bundle is a leaf, or a part of one whose sets are long; a row is a member, not a pair.
    """
    for batch in batches:
        lists = batch.column(1)
        at = np.asarray(lists.offsets)
        for key, x, y in zip(np.asarray(batch.column(0)), at[:-1], at[1:]):
            rows = lists.values.slice(x, y - x)
            tree, ids, comps, sides, n = (np.asarray(rows.field(c)) for c in ("tree", "id", "comp", "side", "n_shingles"))
            tokens = np.frombuffer(b"".join(rows.field("tokens").to_pylist()), np.uint8).reshape(-1, TOKENS)
            keys = np.asarray(rows.field("roots").flatten()).reshape(len(ids), -1)
            ended = np.zeros(keys.shape, bool)
            marks = rows.field("ended")
            ended[np.repeat(np.arange(len(ids)), np.diff(np.asarray(marks.offsets))), np.asarray(marks.flatten())] = True
            # side 2: all with all; 0 and 1: the two blocks of a list, met crosswise.
            one, two = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
            before = int(tree[0])
            left, right = [], []
            for k in range(0, len(one), 16):
                some = one[k : k + 16]
                same = (tokens[some, None, :] == tokens[None, two, :]).sum(axis=2)
                keep = (same >= SCREEN * TOKENS) & (comps[some, None] != comps[None, two])
                keep &= (sides[some, None] != 2) | (some[:, None] < two[None, :])
                i, j = np.nonzero(keep)
                i, j = some[i], two[j]
                new = ~((keys[i, :before] == keys[j, :before]) & ended[i, :before]).any(axis=1)
                left.append(i[new])
                right.append(j[new])
            if not (left and sum(map(len, left))):
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            run = np.cumsum(n) // BUNDLE
            part = run[i] * (run[-1] + 1) + run[j]
            order = np.argsort(part, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                yield _bundle(int(mix(np.array([int(key) % (1 << 64)], np.uint64) + mix(np.array([part[some[0]] + 1], np.uint64))).view(np.int64)[0]), ids[i[some]], ids[j[some]])


def _bundle(key: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first, starts = np.unique(a, return_index=True)
    rest = np.setdiff1d(b, first)
    offsets = np.concatenate([starts, np.full(len(rest) + 1, len(a))]).astype(np.int32)
    members = np.concatenate([first, rest])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(members), key)), pa.array(members), pa.ListArray.from_arrays(offsets, pa.array(b))], names=["bundle", "id", "partners"]
    )


#: Pairs, or rows of small bundles, whose shingle sets are held at once.
CONFIRM = 32
#: Shingles of a bundle's side, on average at most; shared shingles up to which overlaps are a matrix product.
BUNDLE, DENSE = 1 << 20, 1 << 16


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose full shingle sets reach the threshold."""
    for batch in batches:
        keep = []
        for k in range(0, batch.num_rows, CONFIRM):
            one, two = ([s for _, sets in shingle_sets(batch.column(c).slice(k, CONFIRM)) for s in sets] for c in (2, 3))
            for x, y in zip(one, two):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common elements of the sets of each pair."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    if len(i) <= 8 * len(sets) or len(shared) > DENSE:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    both = np.zeros((len(sets), len(sets)), np.float32)
    where = np.full(len(times), -1)
    where[shared] = np.arange(len(shared))
    place = where[place]
    for k in range(0, len(shared), 2048):
        some = np.flatnonzero((place >= k) & (place < k + 2048))
        holds = np.zeros((len(sets), 2048), np.float32)
        holds[owner[some], place[some] - k] = 1
        both += holds @ holds.T
    return np.rint(both[i, j]).astype(np.int64)


def _bundle_links(ids: np.ndarray, partners: pa.Array, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Every member that the confirmed pairs of a bundle link to a smaller one, with the smallest it reaches."""
    order = np.argsort(ids, kind="stable")
    ordered, offsets, b = ids[order], np.asarray(partners.offsets), np.asarray(partners.flatten())
    i = np.repeat(np.arange(len(ids)), np.diff(offsets))
    # Rows that repeat an id are versions of it, and each is met.
    lo, hi = np.searchsorted(ordered, b), np.searchsorted(ordered, b, side="right")
    i = np.repeat(i, hi - lo)
    j = order[np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange((hi - lo).sum())]
    if not len(i):
        return []
    both, n = _overlaps(sets, i, j), np.array([len(s) for s in sets])
    linked = (both > 0) & (DENOMINATOR * both >= NUMERATOR * (n[i] + n[j] - both))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(ids[i[linked]].tolist(), ids[j[linked]].tolist()):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _confirm_bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows ``(bundle, id, partners, text)`` in the order of bundles; some small bundles are scanned together."""

    def links(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = np.asarray(rows.column(0))
        cuts = np.concatenate([np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        start = 0
        while start < len(keys):
            end = int(cuts[max(np.searchsorted(cuts, start + CONFIRM, side="right") - 1, np.searchsorted(cuts, start, side="right"))])
            some = rows.slice(start, end - start)
            sets = [s for _, each in shingle_sets(some.column(3)) for s in each]
            found, x = [], start
            for y in cuts[(cuts > start) & (cuts <= end)]:
                partners = some.column(2).slice(x - start, y - x)
                found += _bundle_links(np.asarray(some.column(1).slice(x - start, y - x)), partners, sets[x - start : y - start])
                x = y
            u, v = (pa.array([f[c] for f in found], pa.int64()) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"])
            start = end

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[-1].column(0)[-1].as_py() == batch.column(0)[-1].as_py():  # the whole batch goes on with a bundle
            held.append(batch)
            continue
        rows = pa.concat_batches([*held, batch])
        keys = np.asarray(rows.column(0))
        last = int(np.searchsorted(keys, keys[-1]))
        yield from links(rows.slice(0, last))
        held = [rows.slice(last)]
    if held:
        yield from links(pa.concat_batches(held))


def confirmed_bundles(docs: DataFrame, bundles: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect what the confirmed pairs of stored ``bundles(bundle, id, partners)`` connect."""
    ids = stored(bundles.select(F.col("id").alias("doc_id")).distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(hinted(ids), "doc_id", "left_semi")
    full = bundles.join(texts.withColumnRenamed("doc_id", "id"), "id").select("bundle", "id", "partners", "text")
    return full.repartition("bundle").sortWithinPartitions("bundle").mapInArrow(_confirm_bundles, "u long, v long")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links ``(u, v)`` among stored candidate ``pairs(a, b)``, by their full sets.

    The id table is broadcast only when counted small; beyond that the texts
    are shuffled once by id.
    """
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(hinted(ids), "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("one"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("two"))
    full = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "one", "two")
    return full.mapInArrow(_confirm, "u long, v long")


def _star_candidates(sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """At most one candidate ``(a, b)`` per document: the best of its nodes' leaders.

    A node's leaders are the smallest members of its smallest and of its largest
    component; a document is paired with one outside its own component.
    """
    keys = sets.select(F.explode("roots").alias("key"), "id")
    keys = keys.withColumn("comp", F.col("id")) if roots is None else keys.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("comp"))
    member = F.struct("comp", "id")
    nodes = keys.groupBy("key").agg(F.min(member).alias("lo"), F.max(member).alias("hi")).where("lo.comp < hi.comp")
    lead = F.when(F.col("comp") != F.col("lo.comp"), F.col("lo.id")).otherwise(F.col("hi.id"))
    pairs = keys.join(nodes, "key").select("id", lead.alias("lead")).distinct()
    tokens = sets.select("id", "tokens")
    rows = (
        pairs.join(tokens, "id")
        .join(tokens.select(F.col("id").alias("lead"), F.col("tokens").alias("lead_tokens")), "lead")
        .select("id", "lead", "tokens", "lead_tokens")
    )
    scored = rows.mapInArrow(_similar, "a long, b long, share double").where(F.col("share") >= SCREEN)
    # A clear leader: the smallest; else the most similar.
    doubtful = F.col("share") < 0.85
    best = F.min(F.struct(doubtful.alias("doubtful"), F.when(doubtful, -F.col("share")).alias("order"), "b"))
    return scored.groupBy("a").agg(best.alias("x")).select("a", F.col("x.b").alias("b"))


def _node_rows(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the nodes that hold several components: small, lopsided and large ones.

    A lopsided node has few blocks of members outside its main component.
    """
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
    nodes = parts.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("most")).where("most.m < n")
    live = stored(rows.join(nodes.select("key", "n", F.col("most.m").alias("m"), F.col("most.comp").alias("major")), "key"), f"level{level}")
    small, lopsided = F.col("n") <= LEAF, F.col("n") - F.col("m") <= OTHERS * BLOCK
    return live.where(small), live.where(~small & lopsided), live.where(~lopsided)


LISTED = ["tree", "id", "comp"]


def _block_leaves(rows: DataFrame) -> DataFrame:
    """A node as lists of two blocks, each compared on its own, but never main with main component.

    The main component and the others are dealt over blocks of BLOCK members;
    every block of others meets every block.
    """
    main = F.col("comp") == F.col("major")
    mains, others = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("m")) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.when(main, mains).otherwise(others)).cast("int")
    spread = rows.select("key", *LISTED, main.alias("main"), own.alias("own"), mains.alias("mains"), others.alias("others"))
    own = F.col("own")
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    against = spread.where("main or other <= own").unionAll(
        spread.where("not main and other = 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("mains") - 1))).withColumn("other", -1 - F.col("other"))
    ).unionAll(spread.where("not main and other > own"))
    # A list is named by (block of others, block met); main blocks count down from -1.
    main_list = F.xxhash64("key", F.col("other"), -1 - own)
    met_main = F.xxhash64("key", own, F.col("other"))
    met_other = F.xxhash64("key", F.least(own, "other"), F.greatest(own, "other"))
    key = F.when(F.col("main"), main_list).when(F.col("other") < 0, met_main).otherwise(met_other)
    side = F.when(F.col("main"), 1).when(F.col("other") < 0, 0).when(own == F.col("other"), 2).when(own < F.col("other"), 0).otherwise(1)
    return against.select(key.alias("key"), *LISTED, side.cast("int").alias("side"))


def _children(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The next level: each node selects BRANCH of the minwise tokens by its own key."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(BRANCH - 1)))
    picked = rows.select("key", *LISTED).join(sets.select("id", "tokens"), "id").select("key", *LISTED, "tokens", turns.alias("turn"))
    place = F.pmod(F.xxhash64("key", "turn"), F.lit(TOKENS)).cast("int")
    token = F.substring("tokens", place + 1, F.lit(1))
    return picked.select(F.xxhash64("key", "turn", token).alias("key"), *LISTED)


def _cross_candidates(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates between different components, from the leaves of all trees, as bundles ``(bundle, id, partners)``.

    Rows that walk down the trees hold ids only. A pair that an earlier tree
    compares in a leaf at its root is left to that tree.
    """
    rows = sets.join(roots, "id", "left").select(F.posexplode("roots").alias("tree", "key"), "id", F.coalesce("root", "id").alias("comp"))
    leaves: list[DataFrame] = []
    first: DataFrame | None = None
    for level in range(DEPTH):
        small, lopsided, large = _node_rows(rows, level)
        leaves += [small.select("key", *LISTED, F.lit(2).alias("side")), _block_leaves(lopsided)]
        if first is None:
            ended = small.select("tree", "id").unionAll(lopsided.select("tree", "id"))
            first = ended.groupBy("id").agg(F.collect_list("tree").alias("ended"))
        if not large.limit(1).count():
            break
        rows = _children(large, sets)
    else:
        leaves.append(_block_leaves(large))
    everything = leaves[0]
    for more in leaves[1:]:
        everything = everything.unionAll(more)
    held = stored(sets.select("id", "n_shingles", "tokens", "roots").join(first, "id", "left").withColumn("ended", F.coalesce("ended", F.array().cast("array<int>"))), "held")
    full = everything.join(held, "id")
    lists = full.groupBy("key").agg(F.collect_list(F.struct(*LISTED, "side", "n_shingles", "tokens", "roots", "ended")).alias("rows")).select("key", "rows")
    return lists.mapInArrow(_leaf_bundles, "bundle long, id long, partners array<long>")


def near_duplicates(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document id of ``docs(doc_id, text)``."""
    sk = stored(sketches(docs.where("doc_id is not null"), tree_count(miss)), "sketch")
    digest = ["d1", "d2", "n_shingles"]
    sets = stored(
        sk.where("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("id"), F.first("roots").alias("roots"), F.first("tokens").alias("tokens")),
        "sets",
    )
    equal = sk.where("n_shingles > 0").join(sets.select(*digest, "id"), digest).where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))

    tried: DataFrame | None = None
    links: DataFrame | None = None
    roots: DataFrame | None = None
    for _ in range(STARS):
        star = _star_candidates(sets, roots)
        star = stored(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), "star")
        found = stored(confirmed(docs, star), "links")
        tried = star if tried is None else tried.unionAll(star)
        links = found if links is None else links.unionAll(found)
        roots = stored(components(links), "roots")
    cross = stored(_cross_candidates(sets, roots), "cross")
    links = links.unionAll(stored(confirmed_bundles(docs, cross), "links"))

    roots = stored(components(links.unionAll(equal)), "roots")
    sizes = sk.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    label = F.coalesce("root", "doc_id")
    return sizes.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", label.alias("component_id"), (label == F.col("doc_id")).alias("kept")
    )
