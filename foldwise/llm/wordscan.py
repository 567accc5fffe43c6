"""Vectorised word scanning of Arrow string columns.

Words are maximal runs of characters other than space and ``\\t \\n \\v \\f \\r``.
A word is identified by a 64-bit polynomial hash of its bytes (ASCII letters
folded when asked), so that whole batches are scanned with a few numpy passes
instead of a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes scanned at once; longer texts are scanned in pieces that end between words.
BLOCK = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _byte_values(fold: bool) -> np.ndarray:
    index = np.arange(256, dtype=np.uint64)
    if fold:
        index[0x41:0x5B] += _U(0x20)
    return mix((index + _U(1)) * _U(0xD6E8FEB86659FD93))


_VALUES = {fold: _byte_values(fold) for fold in (True, False)}
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, BLOCK), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _scan(buf: np.ndarray, cuts: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``buf`` and how many start before each of ``cuts``."""
    n = len(buf)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(cuts), np.int64)
    up, down = _powers(n + 1)
    edge = np.zeros(n + 1, dtype=bool)
    edge[cuts] = True
    word = ~_SPACE[buf]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[fold][buf] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return hashes, np.searchsorted(starts, cuts)


def split_blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """Runs of whole texts, or pieces of one long text, of about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        if j > i:
            yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], True
            i = j
            continue
        at, end = int(offsets[i]), int(offsets[i + 1])
        while at < end:
            stop = min(end, at + size)
            while stop < end:
                gaps = np.flatnonzero(_SPACE[data[at:stop]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                    break
                stop = min(end, stop + (stop - at))
            yield i, i + 1, data[at:stop], np.array([0, stop - at]), stop >= end
            at = stop
        i += 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any run of bytes follows."""
    up, _ = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[False][data] * up[: len(data)], out=total[1:])
    return total


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes; equal runs have equal hashes wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def scan_words(column: pa.Array, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, row after last, word hashes, word offset of each row)``."""
    data, offsets = text_buffers(column)
    held: list[np.ndarray] = []
    for first, last, buf, cuts, done in split_blocks(data, offsets):
        hashes, at = _scan(buf, cuts, fold)
        if last == first + 1:
            held.append(hashes)
            if done:
                whole = np.concatenate(held)
                held = []
                yield first, last, whole, np.array([0, len(whole)])
        else:
            yield first, last, hashes, at


def hash_words(words: list[str], fold: bool = True) -> np.ndarray:
    """Hashes of single words, as ``scan_words`` gives them."""
    return np.concatenate([h for _, _, h, _ in scan_words(pa.array(words, pa.large_string()), fold)] or [np.empty(0, np.uint64)])
