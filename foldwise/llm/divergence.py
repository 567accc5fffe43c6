"""Source divergence audit: iceberg prefix refinement over document terms.

Terms are maximal runs of ASCII letters and non-ASCII characters, ASCII letters
folded. A language keeps the terms of at least ``LEAST`` of its documents. They
are found level by level: byte prefixes of 4, 8, 16, ... bytes are counted by
distinct documents, a prefix below the threshold goes with everything that
begins with it, and only what begins with a kept prefix is extended. A term that
ends within the level's length is decided there. Long rare strings so leave after
their first bytes; no table of all distinct terms is ever built.

Shape of the work:

* one pass over the texts writes which document holds which term how often, some
  megabytes of text a row, over the row's own ordered terms;
* a level is one pass over that table: every row counts its own distinct
  (language, prefix) pairs, Spark adds the partial counts;
* kept prefixes reach the next level as a bitmap of at most ``MOST_BITS`` bits. Two
  prefixes may share a bit, which only lets more candidates through; the
  threshold is always applied to exact counts;
* one more pass counts kept terms by (language, source);
* sums over terms of all pairs of sources are taken term by term: only terms present
  in a source are visited, the rest share one probability; a task emits one sum per
  pair, and the best terms of each group. Group totals are held by every task when they
  are counted few, and joined to the terms, in blocks of ``SOURCES`` by ``SOURCES`` sources, beyond that.

Whole numbers throughout: probabilities by exact decimals, values by 64-bit
integers (their sums stay below 1e18 + 1e9 * kept terms).

Rows: a null text, language or source counts as empty. Every row is a document
of its own, whatever its ``doc_id``, also when rows repeat. A (language, source)
group without terms takes part with counts of zero; a language without kept
terms gives only ``pair`` rows of value 0, one with a single source no ``pair``
rows. Ties go to the smaller item by UTF-8 bytes. Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import LOWER, UPPER, discard, hinted, stored
from foldwise.llm.wordscan import mix, prefix_sums, run_hashes, split_blocks, text_buffers

#: Documents of a language that must hold a term.
LEAST = 3
#: Bytes of text whose postings make one row, about; rows stay small enough for the JVM's ordinary allocation.
CHUNK = 1 << 21
#: Term buckets in which the counts of all chunks are added up, and rows added up at once before.
MOST_BUCKETS, FAN_IN = 4096, 512
#: Bytes of the first level's prefixes; every level doubles them.
FIRST = 4
#: Bits of the map of kept prefixes: about 16 for each, within these bounds (2 MB at most).
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 24
#: Sources of one block of the pair sums.
SOURCES = 256
#: Terms reported for a group.
TOP = 200
SCALE = 1_000_000_000

_U = np.uint64
_GAP = b" "
_TERM = np.zeros(256, dtype=bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def _terms(buf: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Folded terms of some texts and how many start before each of ``cuts``."""
    n = len(buf)
    inside = _TERM[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[cuts] = True
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = _FOLD[buf[inside]]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), np.searchsorted(starts, cuts)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, which the first byte tells."""
    size = next(k for k in (1, 2, 4, 8) if not len(values) or values.max() < 1 << 8 * k - (k == 8))
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _chunk(terms: pa.Array, at: np.ndarray) -> dict[str, bytes]:
    """Distinct terms of some texts in byte order, and each text's distinct terms and counts by their numbers."""
    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    texts, width = len(at) - 1, max(1, len(order))
    place, counts = np.unique(np.repeat(np.arange(texts), np.diff(at)) * width + rank[np.asarray(coded.indices)], return_counts=True)
    vocabulary = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(order))
    sizes = np.diff(np.searchsorted(place, np.arange(texts + 1) * width))
    return {
        "terms": pc.binary_join(vocabulary, _GAP)[0].as_py(), "codes": _narrow(place % width),
        "sizes": _narrow(sizes), "counts": _narrow(counts),
    }


POSTINGS = "langs array<string>, sources array<string>, terms binary, codes binary, sizes binary, counts binary"


def _postings(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """One row for some texts: their languages, sources, terms, and which text holds which term how often."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(2))
        held: list[pa.Array] = []
        for first, last, buf, cuts, done in split_blocks(data, offsets, size):
            terms, at = _terms(buf, cuts)
            if last == first + 1:  # one text, perhaps a piece of it
                held.append(terms)
                if not done:
                    continue
                terms, held = pa.concat_arrays(held), []
                at = np.array([0, len(terms)])
            whole = pa.array([0, last - first], pa.int32())
            names = [pa.ListArray.from_arrays(whole, batch.column(c).slice(first, last - first)) for c in (0, 1)]
            packed = _chunk(terms, at)
            yield pa.RecordBatch.from_arrays([*names, *[pa.array([v], pa.binary()) for v in packed.values()]], names=["langs", "sources", *packed])


def _hashes(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in values.to_pylist()), np.uint64, len(values))


def _in_map(kept: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & _U(64 * len(kept) - 1)
    return (kept[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1


class _Chunk:
    """An unpacked row: ``texts`` and ``codes`` of the postings, distinct ``terms``, languages by number."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        one = lambda c: batch.column(c)[row].as_py()
        self.codes, sizes = _wide(one("codes")), _wide(one("sizes"))
        self.texts = np.repeat(np.arange(len(sizes)), sizes)
        joined = one("terms")
        self.terms = pc.split_pattern(pa.array([joined], pa.binary()), pattern=_GAP).flatten() if joined else pa.array([], pa.binary())
        offsets = np.frombuffer(self.terms.buffers()[1], np.int32)[self.terms.offset : self.terms.offset + len(self.terms) + 1].astype(np.int64) if len(self.terms) else np.zeros(1, np.int64)
        self.starts, self.sizes = offsets[:-1], np.diff(offsets)
        self.sums = prefix_sums(np.frombuffer(self.terms.buffers()[2], np.uint8)[: offsets[-1]]) if offsets[-1] else np.zeros(1, np.uint64)
        langs = batch.column("langs").slice(row, 1).flatten().dictionary_encode()
        self.lang, self.names = np.asarray(langs.indices).astype(np.int64), langs.dictionary
        self.salt = mix(_hashes(self.names.cast(pa.binary())))

    def hashed(self, length: int | None = None) -> np.ndarray:
        """Hash of every term's prefix of some bytes, or of the whole term."""
        return run_hashes(self.sums, self.starts, self.starts + (self.sizes if length is None else np.minimum(self.sizes, length)))


def _level(batches: Iterator[pa.RecordBatch], before: int, length: int, kept: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """``(lang, prefix, ended, hash, docs)``: documents of a chunk that hold a candidate of the level.

    A candidate is what begins with a kept prefix of ``before`` bytes: a term that
    ends within ``length`` bytes, or the prefix of that length of longer terms. Terms
    of a text come in byte order, so equal candidates of a text stand together.
    """
    for batch in batches:
        for row in range(batch.num_rows):
            chunk = _Chunk(batch, row)
            size = chunk.sizes
            use = np.flatnonzero((size > before)[chunk.codes])
            if kept is not None and len(use):
                use = use[_in_map(kept, mix(chunk.hashed(before)[chunk.codes[use]] + chunk.salt[chunk.lang][chunk.texts[use]]))]
            if not len(use):
                continue
            texts, codes = chunk.texts[use], chunk.codes[use]
            cut = pc.binary_slice(chunk.terms, 0, length).dictionary_encode()
            heads, ended, width = np.asarray(cut.indices).astype(np.int64), size <= length, len(cut.dictionary)
            key = (chunk.lang[texts] * width + heads[codes]) * 2 + ended[codes]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (texts[1:] != texts[:-1])
            key, docs = np.unique(key[new], return_counts=True)
            lang, head = key // 2 // width, key // 2 % width
            prefixes = cut.dictionary.take(pa.array(head))
            first = np.searchsorted(heads, np.arange(width))  # ordered terms: equal prefixes stand together
            hashes = mix(chunk.hashed(length)[first][head] + chunk.salt[lang]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [chunk.names.take(pa.array(lang)), prefixes, pa.array(key % 2 == 1), pa.array(hashes), pa.array(docs, pa.int64())],
                names=["lang", "prefix", "ended", "hash", "docs"],
            )


PACKED = "bucket int, langs array<string>, sources array<string>, terms binary, term binary, grp binary, n binary, docs binary"


def _packed(bucket: int, groups: pa.StructArray, terms: pa.Array, term: np.ndarray, grp: np.ndarray, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """Counts by (term, group) of one bucket of terms as one row."""
    whole = pa.array([0, len(groups)], pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms), _GAP)
    numbers = [pa.array([_narrow(v)], pa.binary()) for v in (term, grp, n, docs)]
    names = [pa.ListArray.from_arrays(whole, groups.field(c)) for c in ("lang", "source")]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *names, joined, *numbers], names=[x.split()[0] for x in PACKED.split(", ")])


def _occurrences(batches: Iterator[pa.RecordBatch], kept: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents, by (language, source), of a chunk's terms that may be kept, dealt over buckets by term."""
    for batch in batches:
        for row in range(batch.num_rows):
            chunk = _Chunk(batch, row)
            if not len(chunk.codes):
                continue
            hashes = chunk.hashed()
            use = _in_map(kept, mix(hashes[chunk.codes] + chunk.salt[chunk.lang][chunk.texts]))
            n = _wide(batch.column("counts")[row].as_py())[use]
            sources = batch.column("sources").slice(row, 1).flatten().dictionary_encode()
            pairs = chunk.lang * len(sources.dictionary) + np.asarray(sources.indices)
            pairs, of_text = np.unique(pairs, return_inverse=True)
            groups = pa.StructArray.from_arrays([chunk.names.take(pa.array(pairs // len(sources.dictionary))), sources.dictionary.take(pa.array(pairs % len(sources.dictionary)))], names=["lang", "source"])
            # By bucket, then term, then group.
            order = np.lexsort((np.arange(len(hashes)), hashes % _U(buckets)))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            key, total, docs = _grouped(place[chunk.codes[use]] * len(pairs) + of_text[chunk.texts[use]], n)
            term, grp = key // len(pairs), key % len(pairs)
            ends = np.searchsorted(term, np.searchsorted((hashes % _U(buckets))[order], np.arange(buckets + 1, dtype=np.uint64)))
            for b in np.flatnonzero(np.diff(ends)):
                x, y = ends[b], ends[b + 1]
                own, code = np.unique(term[x:y], return_inverse=True)
                yield _packed(int(b), groups, chunk.terms.take(pa.array(order[own])), code, grp[x:y], total[x:y], docs[x:y])


def _grouped(key: np.ndarray, n: np.ndarray, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ordered distinct keys with the sums of ``n`` and ``docs`` (or how often each occurs)."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    if not len(starts):
        return key, n, n
    seen = np.diff(starts, append=len(order)) if docs is None else np.add.reduceat(docs[order], starts)
    return key[order][starts], np.add.reduceat(n[order], starts), seen


def _merged(table: pa.Table) -> tuple[pa.StructArray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a bucket as one: groups, terms, and the summed (term, group, n, docs)."""
    rows = table.to_pylist()
    terms = pc.split_pattern(pa.array([r["terms"] for r in rows], pa.binary()), pattern=_GAP)
    offsets, coded = np.asarray(terms.offsets), terms.flatten().dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    number: dict[tuple[str, str], int] = {}
    term, grp = [], []
    for at, r in zip(offsets[:-1], rows):
        own = np.array([number.setdefault(x, len(number)) for x in zip(r["langs"], r["sources"])])
        term.append(codes[at + _wide(r["term"])])
        grp.append(own[_wide(r["grp"])])
    n, docs = (np.concatenate([_wide(r[c]) for r in rows]) for c in ("n", "docs"))
    key, n, docs = _grouped(np.concatenate(term) * len(number) + np.concatenate(grp), n, docs)
    groups = pa.StructArray.from_arrays([pa.array([x[i] for x in number], pa.string()) for i in (0, 1)], names=["lang", "source"])
    return groups, coded.dictionary, key // len(number), key % len(number), n, docs


def _counts(packed: DataFrame, chunks: int, least: int) -> DataFrame:
    """``(lang, term, at)`` with the ``(source, n)`` of every kept term, from packed partial counts."""
    def some(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_packed(table.column("bucket")[0].as_py(), *_merged(table))])

    def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        groups, terms, term, grp, n, docs = _merged(table)
        langs = groups.field("lang").dictionary_encode()
        lang = np.asarray(langs.indices).astype(np.int64)[grp]
        order = np.lexsort((grp, lang, term))
        key = (term * len(langs.dictionary) + lang)[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        # Every document is in one chunk, so these add up to the term's documents: what came along by a shared bit goes.
        keep = np.add.reduceat(docs[order], starts) >= least
        sizes = np.diff(starts, append=len(key))
        entries = pa.array(order[np.repeat(keep, sizes)])
        at = pa.StructArray.from_arrays([groups.field("source").take(pa.array(grp)).take(entries), pa.array(n).take(entries)], names=["source", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[keep])]), pa.int32()), at)
        key = key[starts][keep]
        return pa.table({"lang": langs.dictionary.take(pa.array(key % len(langs.dictionary))), "term": terms.take(pa.array(key // len(langs.dictionary))).cast(pa.string()), "at": lists})

    if chunks > FAN_IN:
        share = F.pmod(F.xxhash64("terms", "n"), F.lit(math.ceil(chunks / FAN_IN)))
        packed = packed.withColumn("share", share).groupBy("bucket", "share").applyInArrow(lambda k, t: some(k, t.drop(["share"])), PACKED)
    return packed.groupBy("bucket").applyInArrow(whole, "lang string, term string, at array<struct<source:string,n:long>>")


def _bitmap(prefixes: DataFrame) -> np.ndarray:
    """Bits of the hashes of a stored table; its size has a fixed bound."""
    size = 1 << math.ceil(math.log2(min(MOST_BITS, max(LEAST_BITS, 16 * prefixes.count()))))
    words = prefixes.groupBy(F.expr(f"shiftright(hash & {size - 1}L, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(hash & 63 as int)))").alias("bits"))
    out = np.zeros(size // 64, np.int64)
    for word, bits in words.collect():  # at most MOST_BITS / 64 rows
        out[word] = bits
    return out.view(np.uint64)


def kept_terms(postings: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """``(lang, term, hash)`` of the terms in at least ``least`` documents of a language."""
    texts = postings.where(F.length("terms") > 0).select("langs", "terms", "codes", "sizes")
    found: DataFrame | None = None
    before, length, kept = 0, first, None
    while True:
        step = texts.mapInArrow(
            lambda it, b=before, n=length, k=kept: _level(it, b, n, k), "lang string, prefix binary, ended boolean, hash long, docs long"
        )
        level = stored(step.groupBy("lang", "prefix", "ended").agg(F.sum("docs").alias("docs"), F.first("hash").alias("hash")).where(F.col("docs") >= least), "level")
        terms = level.where("ended").select("lang", F.col("prefix").cast("string").alias("term"), "hash")
        found = terms if found is None else found.unionAll(terms)
        open_ = level.where("not ended")
        if not open_.limit(1).count():
            return found
        before, length, kept = length, 2 * length, _bitmap(open_)


def probability(n: str, total: str, kinds: str) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + kinds))``, exactly; 0 where there are no terms."""
    return F.expr(f"CASE WHEN {total} + {kinds} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(38,0)) * ({n} + 1)) DIV CAST({total} + {kinds} AS DECIMAL(38,0)) ELSE 0L END").cast("long")


def deviation(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV {q}")


def _exact_share(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (n + 1) / whole)``; by unbounded whole numbers where 64 bits would not hold the product."""
    if len(n) and n.max() >= (1 << 63) // SCALE - 1:
        n, whole = n.astype(object), whole.astype(object)
    return (1 + SCALE * (n + 1) // whole).astype(np.int64)


def _sums(base: list[np.ndarray], p: list[np.ndarray], here: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the present terms add to pairs (first, second side) and back, beyond two absent ones."""
    there, back = np.zeros((2, len(base[0]), len(base[1])), np.int64)
    for g in range(len(base[0])):
        has = np.flatnonzero(here[0][:, g])
        if not len(has):
            continue
        x, y = p[0][has, g][:, None], p[1][has]
        square, away = (x - y) * (x - y), ~here[1][has]
        plain = (base[0][g] - base[1]) ** 2
        there[g] = (square // y).sum(axis=0) - len(has) * (plain // base[1])
        back[g] = np.where(away, square // x, 0).sum(axis=0) - away.sum(axis=0) * (plain // base[0][g])
    return there, back


def _dense(lists: pa.ListArray, base: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the terms of some rows in every source of a block, and where they are present."""
    values = np.tile(base, (len(lists), 1))
    here = np.zeros(values.shape, dtype=bool)
    entries = lists.flatten()
    where = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), np.asarray(entries.field("gid")) % width
    values[where], here[where] = np.asarray(entries.field("p")), True
    return values, here


PAIR_SUMS = "lang string, one long, two long, value long"


def _pair_rows(lang: str, one: np.ndarray, two: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    use = (value != 0) & (one != two)
    return pa.RecordBatch.from_arrays([pa.array([lang] * int(use.sum()), pa.string()), *[pa.array(v[use]) for v in (one, two, value)]], names=["lang", "one", "two", "value"])


def _block_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``(lang, one, two, value)`` of the pairs between two blocks of sources."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        a, b = (np.asarray(batch.column(c)).astype(np.int64) for c in ("a", "b"))
        key = (np.asarray(langs.indices).astype(np.int64) << 40) | (a << 20) | b
        for k in np.unique(key):
            rows = np.flatnonzero(key == k)
            some = batch.take(pa.array(rows))
            base = [np.asarray(some.column(c).slice(0, 1).flatten()).astype(np.int64) for c in ("base_a", "base_b")]
            p, here = zip(*(_dense(some.column(c), x, width) for c, x in zip(("at_a", "at_b"), base)))
            there, back = _sums(base, p, here)
            ones, twos = (at + width * int(side[rows[0]]) for at, side in zip(np.indices(there.shape), (a, b)))
            yield _pair_rows(langs.dictionary[int(k >> 40)].as_py(), np.concatenate([ones.ravel(), twos.ravel()]), np.concatenate([twos.ravel(), ones.ravel()]), np.concatenate([there.ravel(), back.ravel()]))


#: Groups and groups of a language up to which every task holds all groups' totals; beyond that they are joined.
MOST_GROUPS, MOST_SOURCES = 20_000, 256

Groups = dict[str, tuple[dict[str, int], np.ndarray, np.ndarray, int, int]]  # number of each source, totals, absent shares, total, kinds

FOUND = "lang string, one long, two long, value long, term string"


def _compared(batches: Iterator[pa.RecordBatch], groups: Groups, top: int) -> Iterator[pa.RecordBatch]:
    """Pair sums, and each group's best ``top`` terms of a batch (``one`` is the group, ``two`` is null).

    Reads ``(lang, term, at)`` with all ``(source, n)`` of a term in one row.
    """
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        of = np.asarray(langs.indices)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            number, totals, absent, total, kinds = groups[lang]
            some = batch.take(pa.array(np.flatnonzero(of == k)))
            lists = some.column("at")
            sizes, entries = np.diff(np.asarray(lists.offsets)), lists.flatten()
            row = np.repeat(np.arange(len(lists)), sizes)
            sources = entries.field("source").dictionary_encode()
            gid = np.array([number[x] for x in sources.dictionary.to_pylist()], np.int64)[np.asarray(sources.indices)]
            n = np.asarray(entries.field("n"))
            p = _exact_share(n, totals[gid] + kinds)
            q = _exact_share(np.add.reduceat(n, np.cumsum(sizes) - sizes), np.full(len(lists), total + kinds, np.int64))[row]
            values, here = np.tile(absent, (len(lists), 1)), np.zeros((len(lists), len(absent)), dtype=bool)
            values[row, gid], here[row, gid] = p, True
            there, back = _sums([absent, absent], [values, values], [here, here])
            sums[lang] = sums.get(lang, 0) + there + back.T
            over = np.flatnonzero(p > q)
            f = (p[over] - q[over]) ** 2 // q[over]
            # The best of each group; ties are settled by the text later, so all that tie with the last one stay.
            order = np.lexsort((-f, gid[over]))
            g, f, over = gid[over][order], f[order], over[order]
            first = np.searchsorted(g, g)
            last = np.minimum(first + top - 1, np.searchsorted(g, g, side="right") - 1)
            keep = f >= f[last] if len(f) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * int(keep.sum()), pa.string()), pa.array(g[keep]), pa.nulls(int(keep.sum()), pa.int64()), pa.array(f[keep]), some.column("term").take(pa.array(row[over[keep]]))],
                names=["lang", "one", "two", "value", "term"],
            )
    for lang, total in sums.items():
        ones, twos = np.indices(total.shape)
        rows = _pair_rows(lang, ones.ravel(), twos.ravel(), total.ravel())
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.string())], names=["lang", "one", "two", "value", "term"])


def _near(groups: DataFrame) -> Groups:
    """The totals of all groups, for tables counted small."""
    out: Groups = {}
    for lang, rows in groups.select("lang", "source", "gid", "total", "kinds", "absent").orderBy("lang", "gid").toPandas().groupby("lang"):
        totals = rows.total.to_numpy(np.int64)
        out[lang] = ({x: i for i, x in enumerate(rows.source)}, totals, rows.absent.to_numpy(np.int64), int(totals.sum()), int(rows.kinds.iloc[0]))
    return out


def _joined(counts: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms above their language's share, and pair sums, with the totals joined: for any number of sources."""
    langs = stored(groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kinds").alias("kinds")), "langs")
    present = counts.select("lang", "term", F.explode("at").alias("x")).select("lang", "term", "x.source", "x.n").join(hinted(groups.select("lang", "source", "gid", "total", "kinds")), ["lang", "source"])
    present = present.select("lang", "term", "n", F.struct("gid", probability("n", "total", "kinds").alias("p")).alias("x"))
    terms = stored(
        present.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list("x").alias("at"))
        .join(hinted(langs), "lang").select("lang", "term", probability("n", "total", "kinds").alias("q"), "at"),
        "terms",
    )
    over = terms.select("lang", "term", "q", F.explode("at").alias("x")).select("lang", "term", "q", F.col("x.gid").cast("long").alias("gid"), "x.p").where("p > q").withColumn("value", deviation("p", "q"))

    block = F.expr(f"gid DIV {SOURCES}")
    blocks = groups.groupBy("lang", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("gid", "absent"))).alias("s")).select("lang", "block", F.col("s.absent").alias("base"))
    blocks = hinted(stored(blocks, "blocks"))
    start = lambda x: x["gid"] - x["gid"] % SOURCES
    inside = lambda c: F.filter("at", lambda x: start(x) == F.col(c) * SOURCES)
    met = (
        terms.select("lang", "at", F.explode(F.array_distinct(F.transform("at", lambda x: (start(x) / SOURCES).cast("long")))).alias("a"))
        .join(blocks.select("lang", F.col("block").alias("a"), F.col("base").alias("base_a")), ["lang", "a"])
        .join(blocks.select("lang", F.col("block").alias("b"), F.col("base").alias("base_b")), "lang")
        .select("lang", "a", "b", "base_a", "base_b", inside("a").alias("at_a"), inside("b").alias("at_b"))
    )
    return over.select("lang", "gid", "term", "value"), met.mapInArrow(lambda it, width=SOURCES: _block_sums(it, width), PAIR_SUMS)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for ``docs(text, lang, source)``."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    postings = stored(docs.select(*text).mapInArrow(lambda it, size=CHUNK: _postings(it, size), POSTINGS), "postings")
    kept = kept_terms(postings, least)
    chunks, tasks = postings.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(2 * tasks, math.ceil(chunks / 4)))
    packed = postings.where(F.length("terms") > 0).mapInArrow(lambda it, k=_bitmap(kept): _occurrences(it, k, buckets), PACKED)
    counts = stored(_counts(packed, chunks, least), "counts")

    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    sizes = counts.select("lang", F.explode("at").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    every = postings.select(F.explode(F.array_distinct(F.arrays_zip(F.col("langs").alias("lang"), F.col("sources").alias("source")))).alias("g")).select("g.lang", "g.source").distinct()
    groups = stored(
        every.join(sizes, ["lang", "source"], "left").join(kinds, "lang", "left")
        .select("lang", "source", number.alias("gid"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds"))
        .withColumn("absent", probability("0", "total", "kinds")),
        "groups",
    )
    discard(postings)

    n, widest = groups.agg(F.count("*"), F.coalesce(F.max("gid") + 1, F.lit(0))).first()
    if n <= MOST_GROUPS and widest <= MOST_SOURCES:
        found = stored(counts.mapInArrow(lambda it, g=_near(groups): _compared(it, g, top), FOUND), "found")
        over = found.where("two is null").select("lang", F.col("one").alias("gid"), "term", "value")
        sums = found.where("two is not null").drop("term")
    else:
        over, sums = _joined(counts, groups)

    best = Window.partitionBy("lang", "gid").orderBy(F.desc("value"), "term")
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    names = hinted(groups.select("lang", F.col("gid").cast("long").alias("gid"), "source"))
    by_term = over.join(names, ["lang", "gid"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # Pairs of sources: what two absent terms give, for all terms, and the difference of the present ones.
    extra = sums.groupBy("lang", "one", "two").agg(F.sum("value").alias("extra"))
    one, two = (groups.select("lang", F.col("gid").cast("long").alias(n), F.col("source").alias(s), F.col("absent").alias(q), *k) for n, s, q, k in (("one", "source", "p0", ["kinds"]), ("two", "item", "q0", [])))
    value = F.when(F.col("kinds") > 0, F.col("kinds") * F.expr("((p0 - q0) * (p0 - q0)) DIV greatest(q0, 1L)")).otherwise(F.lit(0)) + F.coalesce("extra", F.lit(0))
    pairs = one.join(hinted(two), "lang").where("one <> two").join(extra, ["lang", "one", "two"], "left").select("lang", "source", "item", value.cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return by_pair.unionByName(by_term)


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST}),
here AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
total AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
size AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN here USING (lang, source) GROUP BY ALL),
dense AS (
  SELECT lang, source, term, coalesce(here.n, 0) AS c, kept.n AS c_lang,
    (1 + ({SCALE}::HUGEINT * (coalesce(here.n, 0) + 1)) // (size.n + v)::HUGEINT) AS p,
    (1 + ({SCALE}::HUGEINT * (kept.n + 1)) // (total.n + v)::HUGEINT) AS q
  FROM size JOIN kept USING (lang) JOIN total USING (lang) LEFT JOIN here USING (lang, source, term)),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(sum(((a.p - b.p) * (a.p - b.p)) // b.p), 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN dense a ON a.lang = g.lang AND a.source = g.source
  LEFT JOIN dense b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term
  GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM dense WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= {TOP}
"""
