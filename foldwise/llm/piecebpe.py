"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is escaped as the library does (a leading ``▁``, spaces as ``▁``) and cut
before every run of ``▁``, since no piece of such a model holds a ``▁`` after
another character. The pieces between cuts, here called words, are independent.
New words of a batch are merged together: one flat array of symbols, the rank of
every adjacent pair by table lookup, the minimum rank of each word by segmented
reduction, the leftmost such pair of every word merged at once, compaction, until
no pair remains. Where the merged symbol cannot start a better pair, all
its occurrences in the word are merged in the same round, which gives the same
result as one after the other. Results are kept by word in a bounded table.

Decoding turns ids into bytes by table, drops control ids, reads bytes as UTF-8
with one replacement character per invalid byte, and drops the leading space.

Rows: null text counts as empty and encodes as begin and end alone. Results
are per row; null and repeated ids and repeated rows keep their rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.wordcache import groups_of

SPACE = "▁"
#: Words kept per worker process; when full, the table starts anew.
KEPT = 300_000
#: Longer words are merged by a heap of pairs, n log n, on their own.
LONG = 2_000
NONE = np.int64(1) << 40


class PieceModel:
    """Tables of a SentencePiece BPE model file with byte fallback."""

    _made: dict[str, "PieceModel"] = {}

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(Path(path).read_bytes())
        self._check(model, proto)
        kinds = proto.ModelProto.SentencePiece
        self.bos, self.eos, self.unk = model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.unk_id
        pieces = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        self.bytes_of: list[bytes | None] = [None] * len(model.pieces)  # None: a control id
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.NORMAL:
                self.bytes_of[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.UNKNOWN:
                self.bytes_of[i] = model.trainer_spec.unk_surface.encode()
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        # Symbols: the pieces by id, then single characters that only occur inside pieces.
        self.symbol = {p: i for i, p, _ in pieces}
        n = len(model.pieces)
        for _, p, _ in pieces:
            for c in p:
                if c not in self.symbol:
                    self.symbol[c] = n
                    n += 1
        self.n_symbols, self.n_ids = n, len(model.pieces)
        scores = sorted({s for _, _, s in pieces}, reverse=True)
        rank_of_score = {s: r for r, s in enumerate(scores)}
        rank = {i: rank_of_score[s] for i, _, s in pieces}
        pairs = sorted(
            (self.symbol[p[:k]] * n + self.symbol[p[k:]], i) for i, p, _ in pieces if len(p) > 1 for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol
        )
        self.pair_keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.pair_made = np.array([i for _, i in pairs] + [0], np.int64)
        self.pair_rank = np.array([rank[i] for _, i in pairs] + [NONE], np.int64)
        # A piece is safe if no pair that it takes part in ranks at or before it.
        part, made = np.concatenate([self.pair_keys[:-1] // n, self.pair_keys[:-1] % n]), np.tile(self.pair_made[:-1], 2)
        ranks = np.full(n, NONE, np.int64)
        ranks[list(rank)] = list(rank.values())
        self.safe = np.ones(n, bool)
        self.safe[part[ranks[made] <= ranks[part]]] = False
        shared = np.bincount(np.array(list(rank.values())), minlength=len(scores))
        self.safe[[i for i, r in rank.items() if shared[r] > 1]] = False
        self.pair_table: dict[int, int] | None = None
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _check(model, proto) -> None:
        spec, norm = model.trainer_spec, model.normalizer_spec
        plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        kinds = proto.ModelProto.SentencePiece
        known = {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN}
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in model.pieces if p.type == kinds.NORMAL)
        if not (spec.model_type == spec.BPE and spec.byte_fallback and not spec.treat_whitespace_as_suffix and plain) or inner or {p.type for p in model.pieces} - known:
            raise ValueError("needs an identity-normalised BPE model with byte fallback and no inner spaces in its pieces")

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NONE where there is no such piece."""
        key = left * self.n_symbols + right
        at = np.searchsorted(self.pair_keys, key)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], NONE), self.pair_made[at]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge flat ``symbols``, grouped by ``word`` number, until no pair remains."""
        done_s, done_w, done_o = [], [], []
        order = np.arange(len(symbols))
        while len(symbols) > 1:
            rank, made = self._lookup(symbols[:-1], symbols[1:])
            rank[word[:-1] != word[1:]] = NONE
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(np.append(rank, NONE), starts)
            sizes = np.diff(np.append(starts, len(word)))
            low_here = np.repeat(low, sizes)
            live = low_here < NONE
            if not live.all():  # words without a pair are finished
                done_s.append(symbols[~live])
                done_w.append(word[~live])
                done_o.append(order[~live])
                symbols, word, order = symbols[live], word[live], order[live]
                if len(symbols) < 2:
                    break
                keep = live[:-1]
                rank, made, low_here = rank[keep][: len(symbols) - 1], made[keep][: len(symbols) - 1], low_here[live]
            hit = rank == low_here[:-1]
            spots = np.flatnonzero(hit)
            w = word[spots]
            leftmost = np.concatenate([[True], w[1:] != w[:-1]])
            # Adjacent hits overlap: of each run, every second one from its start is merged.
            run = np.concatenate([[True], (spots[1:] != spots[:-1] + 1) | (w[1:] != w[:-1])])
            run_start = np.maximum.accumulate(np.where(run, spots, 0))
            even = (spots - run_start) % 2 == 0
            spots = spots[np.where(self.safe[made[spots]], even, leftmost)]
            symbols[spots] = made[spots]
            rest = np.ones(len(symbols), bool)
            rest[spots + 1] = False
            symbols, word, order = symbols[rest], word[rest], order[rest]
        s, w, o = (np.concatenate([*d, x]) for d, x in ((done_s, symbols), (done_w, word), (done_o, order)))
        sort = np.argsort(o, kind="stable")
        return s[sort], w[sort]

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one long word, with a heap of pairs."""
        if self.pair_table is None:
            self.pair_table = {int(k): j for j, k in enumerate(self.pair_keys[:-1])}
        n, after, before = self.n_symbols, list(range(1, len(symbols))) + [-1], list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (at := self.pair_table.get(symbols[i] * n + symbols[j])) is not None:
                heapq.heappush(heap, (int(self.pair_rank[at]), i, symbols[i] * n + symbols[j], int(self.pair_made[at])))

        for i in range(len(symbols)):
            offer(i)
        alive = [True] * len(symbols)
        while heap:
            _, i, key, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or symbols[i] * n + symbols[j] != key:
                continue
            symbols[i], alive[j], after[i] = made, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, a in zip(symbols, alive) if a]

    def _start(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Symbols of the characters of all words; unknown characters get numbers of their own."""
        chars = "".join(words)
        codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, at = np.unique(codes, return_inverse=True)
        names = [chr(c) for c in distinct]
        known = np.array([self.symbol.get(c, -1) for c in names], np.int64)
        unknown = np.flatnonzero(known < 0)
        known[unknown] = self.n_symbols + unknown
        return known[at], np.repeat(np.arange(len(words)), [len(w) for w in words]), names

    def learn(self, words: list[str]) -> None:
        """Encode new words into the table."""
        short = [w for w in words if len(w) <= LONG]
        for k in range(0, len(short), 20_000):
            some = short[k : k + 20_000]
            symbols, word, names = self._start(some)
            # Unknown characters take part in no pair: outside the range of symbol numbers, their keys match nothing.
            symbols, word = self.merge(symbols.copy(), word)
            self._keep(some, symbols, word, names)
        for w in words:
            if len(w) > LONG:
                symbols, _, names = self._start([w])
                merged = np.array(self.merge_long(symbols.tolist()), np.int64)
                self._keep([w], merged, np.zeros(len(merged), np.int64), names)

    def _keep(self, words: list[str], symbols: np.ndarray, word: np.ndarray, names: list[str]) -> None:
        """Ids of merged symbols: those that are no piece fall back to bytes."""
        odd = np.flatnonzero(symbols >= self.n_ids)
        if len(odd):
            inner = {v: c for c, v in self.symbol.items() if v >= self.n_ids}
            parts, last, lengths = [], 0, np.ones(len(symbols), np.int64)
            for i in odd:
                s = int(symbols[i])
                char = inner[s] if s < self.n_symbols else names[s - self.n_symbols]
                ids = self.byte_id[np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)]
                parts += [symbols[last:i], ids]
                lengths[i] = len(ids)
                last = i + 1
            symbols = np.concatenate([*parts, symbols[last:]])
            word = np.repeat(word, lengths)
        flat = symbols.astype("<u4").tobytes()
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        for i, w in enumerate(words):
            self.words[w] = flat[4 * cuts[i] : 4 * cuts[i + 1]]

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit numbers.

        Texts are taken in groups of about GROUP characters, so that the new words
        of a group are merged together.
        """
        begin, end = (int(i).to_bytes(4, "little") for i in (self.bos, self.eos))
        for group in groups_of(texts):
            parts = [words_of(t) for t in group]
            table = self.words
            new = {w for words in parts for w in words if w not in table}
            if len(table) + len(new) > KEPT:
                table.clear()
                new = {w for words in parts for w in words}
            if new:
                self.learn(list(new))
            for words in parts:
                yield b"".join([begin, *[table[w] for w in words], end])

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))

    def decode(self, raw: bytes) -> str:
        """Text of ids given as little-endian unsigned 32-bit numbers."""
        ids = np.frombuffer(raw, "<u4").tolist()
        pieces = [(i, self.bytes_of[i] or b"") for i in ids]
        first = next((k for k, (i, b) in enumerate(pieces) if b), None)
        if first is None:
            return ""
        i, b = pieces[first]
        if not self.is_byte[i] and i != self.unk and b.startswith(b" "):
            pieces[first] = (i, b[1:])
        inner = pieces[first : len(pieces) - (self.bytes_of[ids[-1]] is None)]
        if all(b is not None for b in map(self.bytes_of.__getitem__, ids[first : first + len(inner)])):
            try:
                return b"".join([b for _, b in inner]).decode("utf-8")
            except UnicodeDecodeError:
                pass
        return self._decode_runs(pieces)

    def _decode_runs(self, pieces: list[tuple[int, bytes]]) -> str:
        """Byte ids form characters only among themselves; each byte that forms none is replaced."""
        out, run = [], b""
        for i, b in [*pieces, (-1, b"")]:
            if i >= 0 and self.is_byte[i]:
                run += b
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode("utf-8"))
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            out.append(b.decode("utf-8"))
        return "".join(out)


_CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def words_of(text: str) -> list[str]:
    """The escaped text, cut before every run of spaces."""
    if not text:
        return []
    return _CUT.findall(SPACE + text.replace(" ", SPACE))


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = PieceModel.load(path)
    for batch in batches:
        n, ids, decoded = [], [], []
        for raw in model.encode_many(t.as_py() or "" for t in batch.column(1)):
            n.append(len(raw) // 4)
            ids.append(hashlib.sha256(raw).hexdigest())
            decoded.append(hashlib.sha256(model.decode(raw).encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: number of ids, digest of the ids, digest of the decoded text. One narrow pass."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _digests(it, path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Adds ``ids array<int>`` to ``docs(..., text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.load(path)
        for batch in batches:
            ids = [np.frombuffer(raw, "<u4").astype(np.int32) for raw in model.encode_many(t.as_py() or "" for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, ids array<int>")
