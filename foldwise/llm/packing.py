"""Best-fit decreasing packing of token pieces into sequences of fixed length.

Bins with the same remaining room are interchangeable, so best-fit decreasing
over any number of pieces is a plan over lengths: for each length, longest
first, a segment tree over the remaining capacities gives the tightest room that
holds open bins, and its bins are filled one after the other with as many pieces
as each still takes, all at once. The plan depends on the number of pieces of each length only
(at most ``CAPACITY`` numbers) and names, for ranges of pieces of one length,
the range of bins and the offset they take. Spark counts the lengths, numbers
the pieces of a length without sorting them in one task, and looks the ranges up.

Rows: null text counts as empty and packs as the end token alone. Null and
repeated ids and repeated rows are packed row by row. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import stored
from foldwise.llm.wordcache import ChunkCache

CAPACITY = 4096
END = 1
#: Parts that number the pieces of each length; one length may hold all pieces.
PARTS = 128


class RoomTree:
    """Segment tree over rooms 0..capacity: the smallest room of at least some size that has open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, present: bool) -> None:
        i = self.size + room
        self.any[i] = present
        i >>= 1
        while i:
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = self.size + least
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, pieces, first bin, offset)`` ranges of best-fit decreasing."""
    tree = RoomTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    moves, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if open_bins[room] and sum(open_bins[room][-1]) == first:
                open_bins[room][-1] = (open_bins[room][-1][0], open_bins[room][-1][1] + n)
            else:
                open_bins[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length  # new bins take as many of this length as fit: the tightest bin is always the last one
                full, rest = divmod(left, per)
                for k in range(per):  # the k-th piece of each bin; the last bin may hold fewer
                    n = full + (k < rest)
                    if n:
                        moves.append((length, rank, n, bins, k * length))
                    rank += n
                if full:
                    put(capacity - per * length, bins, full)
                if rest:
                    put(capacity - rest * length, bins + full, 1)
                bins += full + bool(rest)
                left = 0
                continue
            first, n = open_bins[room].pop()
            per = room // length  # a bin just used is the tightest: it takes all it can before the next bin is touched
            full, rest = divmod(min(left, n * per), per)
            for k in range(per):
                take = full + (k < rest)
                if take:
                    moves.append((length, rank, take, first, capacity - room + k * length))
                rank += take
            used = full + bool(rest)
            if used < n:
                open_bins[room].append((first + used, n - used))
            if not open_bins[room]:
                tree.set(room, False)
            if full:
                put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            left -= full * per + rest
    return moves


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int) -> Iterator[pa.RecordBatch]:
    cache = ChunkCache.words(tokenizer)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        rows, piece, start, length, crc = [], [], [], [], []
        for i, raw in enumerate(cache.encode_many(t.as_py() or b"" for t in texts)):
            raw += END.to_bytes(4, "little")
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                rows.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of at most ``capacity`` tokens."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _pieces(it, tokenizer, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``rows(..., length)``.

    Every piece is stored with a number of its own, so a task that runs again
    repeats its result. Full pieces take a sequence each and skip the numbering.
    """
    names = rows.columns
    spot = F.monotonically_increasing_id()
    whole = stored(rows.withColumn("_spot", spot).withColumn("_part", F.pmod(F.xxhash64("_spot"), F.lit(PARTS)).cast("int")), "pieces")
    loose = whole.where(F.col("length") < capacity)
    # One number for each length and part, CAPACITY * PARTS at most, whatever the input.
    sizes = loose.groupBy("length", "_part").agg(F.count("*").alias("n")).toPandas()
    grid = np.zeros((capacity + 1, PARTS), np.int64)
    grid[sizes["length"].to_numpy(np.int64), sizes["_part"].to_numpy(np.int64)] = sizes["n"].to_numpy(np.int64)
    first = np.cumsum(grid, axis=1) - grid
    totals = grid.sum(axis=1)
    moves = np.array(plan({int(k): int(totals[k]) for k in np.flatnonzero(totals)}, capacity), np.int64).reshape(-1, 5)
    moves = moves[np.lexsort((moves[:, 1], moves[:, 0]))]
    stride = np.int64(totals.sum() + 1)
    starts = moves[:, 0] * stride + moves[:, 1]
    table = rows.sparkSession.sparkContext.broadcast((first, moves, starts, stride))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, moves, starts, stride = table.value
        for batch in batches:
            length, part, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "_part", "_rank"))
            rank = rank - 1 + first[length, part]
            move = moves[np.searchsorted(starts, length * stride + rank, side="right") - 1]
            out = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(move[:, 3] + rank - move[:, 1]), pa.array(move[:, 4])], names=[*names, "sequence_id", "offset"])

    ranked = loose.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("_spot")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    together = ranked.select(*names, "_part", "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")
    alone = whole.where(F.col("length") >= capacity).select(*names, (-1 - F.col("_spot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return together.unionAll(alone)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their sequence and offset."""
    return packed(pieces(docs, tokenizer, capacity), capacity)
