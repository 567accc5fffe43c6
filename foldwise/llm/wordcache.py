"""Tokenizer results by word: a text's ids are the joined ids of its words.

Natural text repeats its words, so a bounded table of words per Python worker
replaces most calls of the tokenizer. It holds only for tokenizers whose
symbols never cross the white space between words.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Words kept per worker process; when full, the table starts anew.
KEPT = 700_000

#: Characters whose new words are looked up together.
GROUP = 2_000_000

#: A stop or comma after an ASCII letter or digit always starts a token of its own.
_STOP = re.compile(rb"(?<=[a-z0-9])([.,])")


def groups_of(texts: Iterable) -> Iterator[list]:
    """Consecutive texts in groups of about GROUP characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


class ChunkCache:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers, word by word."""

    _made: dict[str, "ChunkCache"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table: dict[bytes, bytes] = {}

    @classmethod
    def words(cls, path: str) -> "ChunkCache":
        """The worker's table for a tokenizer file that drops white space."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def words_of(self, raw: bytes) -> list[bytes]:
        folded = _STOP.sub(rb" \1", raw.lower())
        # Lower-casing ASCII and cutting off stops first only change what special tokens see.
        return (raw if any(s.lower() in folded for s in self.special) else folded).split()

    def encode_many(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        for group in groups_of(texts):
            parts = [self.words_of(t) for t in group]
            table = self.table
            seen = set().union(*parts)
            new = seen.difference(table)
            if len(table) + len(new) > KEPT:
                table.clear()
                new = seen
            some = list(new)
            found = self.tokenizer.encode_batch([w.decode("utf-8", "surrogatepass") for w in some], add_special_tokens=False)
            for w, e in zip(some, found):
                table[w] = np.array(e.ids, dtype="<u4").tobytes()
            for words in parts:
                yield b"".join(map(table.__getitem__, words))

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text.encode("utf-8", "surrogatepass")]))
