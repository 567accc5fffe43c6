"""Deterministic pseudo-random columns derived from a key.

``x -> x**5`` is a permutation modulo ``2**31 - 1``, so one multiplication chain
scatters consecutive keys and different seeds give unrelated orders.  Only
64-bit integer arithmetic is used: no overflow for any non-negative key, and the
same value on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2_147_483_647
SEED_STEP = 1_000_003


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_key(c: str | Column) -> Column:
    """A 52-bit number for a text id, from the head of its MD5; the same on every engine."""
    return F.conv(F.substring(F.md5(_col(c).cast("string")), 1, 13), 16, 10).cast("long")


def keyed_hash(key: str | Column, seed: int) -> Column:
    """Integer in [0, PRIME) from a non-negative integer key and a seed."""
    p = F.lit(PRIME)
    x = (F.pmod(_col(key).cast("long"), p) + F.lit(seed * SEED_STEP % PRIME).cast("long")) % p
    x2 = (x * x) % p
    x4 = (x2 * x2) % p
    return (x4 * x) % p


def unit_noise(key: str | Column, seed: int) -> Column:
    """Uniform number in [-1, 1) from a key and a seed."""
    return keyed_hash(key, seed).cast("double") / F.lit(float(PRIME)) * 2.0 - 1.0


def unit_uniform(key: str | Column, seed: int) -> Column:
    """Uniform number in [0, 1)."""
    return keyed_hash(key, seed).cast("double") / F.lit(float(PRIME))


def text_key_sql(key: str) -> str:
    """``text_key`` as SQL text."""
    return f"CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT)"


def hash_sql(key: str, seed: int) -> str:
    """The same hash of a non-negative number as SQL text."""
    x = f"(({key} % {PRIME} + {seed * SEED_STEP % PRIME}) % {PRIME})"
    x2 = f"(({x} * {x}) % {PRIME})"
    x4 = f"(({x2} * {x2}) % {PRIME})"
    return f"(({x4} * {x}) % {PRIME})"


def noise_sql(key: str, seed: int) -> str:
    return f"(CAST({hash_sql(key, seed)} AS DOUBLE) / CAST({PRIME} AS DOUBLE) * 2.0 - 1.0)"
