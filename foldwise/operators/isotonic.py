"""Exact isotonic regression of every (repeat, fold) cell at once, as a table of maps.

Predictions are spread over range buckets.  A bucket pools its adjacent violators for all cells
together, since pooling inside a range never has to be undone; block lists then meet
in a tree, neighbours first, where only blocks around the borders still pool.  The final
blocks are cut at the bucket borders again and stored, and rows meet the blocks of their
own bucket, so neither the points nor a whole map reaches the driver.  What a tree node holds
are the blocks of its range: as many as the fitted maps have steps.

A cell's map is fitted on the other folds of its repeat.  Between blocks a map is linear, outside it is constant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import clip
from ..session import default_buckets, discard, pin, stored
from .folds import N_FOLDS

#: Children of a tree node.
FAN = 8

Lists = list[np.ndarray]  # one (blocks x 4) array of first x, last x, weight, weighted sum for every cell


def pooled(blocks: np.ndarray) -> np.ndarray:
    """Pool adjacent violators of blocks in the order of x."""
    first, last, weight, total = ([] for _ in range(4))
    for a, b, w, s in blocks:
        while weight and total[-1] * w >= s * weight[-1]:  # the mean before is not below
            a, w, s = first.pop(), w + weight.pop(), s + total.pop()
            last.pop()
        first.append(a), last.append(b), weight.append(w), total.append(s)
    return np.array([first, last, weight, total]).T.reshape(-1, 4)


def _write(lists: Lists) -> tuple[bytes, bytes]:
    return np.array([len(x) for x in lists], "<i8").tobytes(), np.concatenate([x.reshape(-1, 4) for x in lists]).astype("<f8").tobytes()


def _read(sizes: bytes, blocks: bytes) -> Lists:
    flat = np.frombuffer(blocks, "<f8").reshape(-1, 4)
    return np.split(flat, np.cumsum(np.frombuffer(sizes, "<i8"))[:-1])


@dataclass(frozen=True)
class Maps:
    """Segments ``(*groups, bucket, sizes, blocks, n)`` of the maps, and the borders of the buckets."""

    segments: DataFrame
    borders: list[float]
    groups: tuple[str, ...]
    cells: int
    frozen: bool


def _bucket(x: Column, borders: Sequence[float]) -> Column:
    """Number of borders at or below x; the borders steer the work, not the result."""
    if not borders:
        return F.lit(0)
    edges = F.array(*[F.lit(float(b)) for b in borders])
    return F.size(F.filter(edges, lambda b: b <= x))


def fit(df: DataFrame, pred: str, target: str, groups: Sequence[str] = (), n_repeats: int = 3, frozen: bool = False, buckets: int | None = None) -> Maps:
    """Maps of every cell (``frozen``: one map of all rows) and group, from ``df(folds, pred, target, *groups)``."""
    keys = tuple(f"_g{i}" for i in range(len(groups)))
    held = F.array().cast("array<int>") if frozen else F.col("folds")
    slim = df.select(held.alias("folds"), clip(pred).alias("x"), F.col(target).cast("double").alias("y"), *[F.col(g).alias(k) for g, k in zip(groups, keys)])
    slim = slim.where("x is not null and y is not null")
    buckets = buckets or default_buckets(df.sparkSession)
    probs = [i / buckets for i in range(1, buckets)]
    borders = sorted(set(slim.select("x").distinct().approxQuantile("x", probs, 0.25 / buckets))) if probs else []
    cells = 1 if frozen else n_repeats * N_FOLDS
    # One row per value and fold combination: a value that a third of the rows share is some rows.
    points = slim.groupBy(*keys, "x", "folds").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s"))
    points = points.withColumn("bucket", _bucket(F.col("x"), borders).cast("int"))
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    head = "".join(f"{k} {types[k]}, " for k in keys)
    schema = head + "bucket int, sizes binary, blocks binary"

    def local(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, at = np.unique(np.asarray(table.column("x").combine_chunks()), return_inverse=True)
        n, s = (np.asarray(table.column(c).combine_chunks()) for c in ("n", "s"))
        total = [np.bincount(at, v, minlength=len(x)) for v in (n, s)]
        lists = []
        if frozen:
            lists.append(pooled(np.array([x, x, *total]).T))
        else:
            folds = np.array(table.column("folds").to_pylist())
            for r in range(n_repeats):
                for f in range(N_FOLDS):
                    own = np.flatnonzero(folds[:, r] != f)  # summed afresh: differences would leave remainders in empty values
                    w, t = (np.bincount(at[own], v[own], minlength=len(x)) for v in (n, s))
                    some = w > 0
                    lists.append(pooled(np.array([x[some], x[some], w[some], t[some]]).T))
        return _packed(table, lists, bucket=table.column("bucket")[0].as_py())

    def _packed(table: pa.Table, lists: Lists, bucket: int) -> pa.Table:
        sizes, blocks = _write(lists)
        out = {k: table.column(k).slice(0, 1) for k in keys}
        return pa.table({**out, "bucket": pa.array([bucket], pa.int32()), "sizes": pa.array([sizes], pa.binary()), "blocks": pa.array([blocks], pa.binary())})

    def together(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("bucket").combine_chunks()))
        parts = [_read(table.column("sizes")[int(i)].as_py(), table.column("blocks")[int(i)].as_py()) for i in order]
        return _packed(table, [pooled(np.concatenate(lists)) for lists in zip(*parts)], bucket=table.column("bucket")[int(order[0])].as_py() // FAN)

    level = points.groupBy(*keys, "bucket").applyInArrow(local, schema)
    last = len(borders)
    while last > 0:
        level = level.withColumn("_node", F.floor(F.col("bucket") / FAN)).groupBy(*keys, "_node").applyInArrow(lambda k, t: together(k, t.drop(["_node"])), schema)
        last //= FAN
    edges = np.array(borders)

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The maps of a group, bucket by bucket, each with the blocks next to it."""
        lists = _read(table.column("sizes")[0].as_py(), table.column("blocks")[0].as_py())
        rows = {"bucket": [], "sizes": [], "blocks": [], "n": []}
        n = np.array([x[:, 2].sum() for x in lists], "<f8").tobytes()
        for b in range(len(edges) + 1):
            lo, hi = edges[b - 1] if b else -np.inf, edges[b] if b < len(edges) else np.inf
            some = []
            for x in lists:
                i, j = np.searchsorted(x[:, 1], lo), np.searchsorted(x[:, 0], hi)
                some.append(x[max(0, i - 1) : j + 1])
            sizes, blocks = _write(some)
            for k, v in (("bucket", b), ("sizes", sizes), ("blocks", blocks), ("n", n)):
                rows[k].append(v)
        out = {k: pa.concat_arrays([table.column(k).combine_chunks().slice(0, 1)] * len(rows["n"])) if table.column(k).num_chunks else table.column(k) for k in keys}
        return pa.table({**out, "bucket": pa.array(rows["bucket"], pa.int32()), **{k: pa.array(rows[k], pa.binary()) for k in ("sizes", "blocks", "n")}})

    segments = stored(level.groupBy(*keys).applyInArrow(cut, schema + ", n binary"), "isotonic")
    return Maps(segments, borders, tuple(groups), cells, frozen)


def values(df: DataFrame, maps: Maps, pred: str, out: str, key: str = "row_id") -> DataFrame:
    """Add ``out``: one ``(v, n)`` for every repeat, from the map of the row's own cell and group.

    ``n`` counts the training rows of that map; a row whose group has no map gets nulls.
    """
    keys = [f"_g{i}" for i in range(len(maps.groups))]
    held = F.array(F.lit(0)) if maps.frozen else F.col("folds")
    slim = df.select(F.col(key).alias("_id"), clip(pred).alias("x"), held.alias("_folds"), *[F.col(g).alias(k) for g, k in zip(maps.groups, keys)])
    slim = slim.withColumn("bucket", _bucket(F.col("x"), maps.borders).cast("int"))
    id_type = dict(df.dtypes)[key]
    per_repeat = 1 if maps.frozen else N_FOLDS
    repeats = maps.cells // per_repeat

    def score(_: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("_id")
        v, n = np.full((2, repeats, left.num_rows), np.nan)
        if left.num_rows and right.num_rows:
            x, folds = np.asarray(left.column("x").combine_chunks()), np.array(left.column("_folds").to_pylist())
            lists, rows = _read(right.column("sizes")[0].as_py(), right.column("blocks")[0].as_py()), np.frombuffer(right.column("n")[0].as_py(), "<f8")
            for r in range(repeats):
                for f in range(per_repeat):
                    blocks = lists[r * per_repeat + f]
                    at = np.flatnonzero(folds[:, r] == f)
                    if len(blocks) and len(at):
                        means = np.repeat(blocks[:, 3] / blocks[:, 2], 2)
                        v[r, at], n[r, at] = np.interp(x[at], blocks[:, :2].ravel(), means), rows[r * per_repeat + f]
        bad = np.isnan(v.T.ravel())
        pairs = pa.StructArray.from_arrays([pa.array(v.T.ravel(), mask=bad), pa.array(n.T.ravel(), mask=bad)], names=["v", "n"])
        lists_ = pa.ListArray.from_arrays(pa.array(np.arange(0, left.num_rows * repeats + 1, repeats), pa.int32()), pairs)
        return pa.table({"_id": ids, out: lists_})

    met = slim.groupBy(*keys, "bucket").cogroup(maps.segments.groupBy(*keys, "bucket")).applyInArrow(score, f"_id {id_type}, {out} array<struct<v:double,n:double>>")
    return df.join(met.withColumnRenamed("_id", key), key, "left")


def post(overall: str, grouped: str | None = None, min_rows: int = 0) -> Column:
    """Mean over the repeats of the clipped maps; a missing or thin group falls back to the overall map."""
    if grouped is None:
        picked = F.transform(overall, lambda x: clip(x["v"]))
    else:
        picked = F.zip_with(overall, grouped, lambda a, b: clip(F.when(b["n"] >= min_rows, b["v"]).otherwise(a["v"])))
    return clip(F.aggregate(picked, F.lit(0.0), lambda s, x: s + x) / F.size(picked))
