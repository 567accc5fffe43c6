"""Embedding near-dedup by sorted projection passes.

Equal vectors become one class first. Every pass orders the classes by a key of
concatenated random hashes (cross-polytope hashes of random rotations: the
index and sign of the largest rotated coordinate), so near vectors stand close
together. The order is cut into blocks that overlap by a window; each vector is
compared with at least ``WINDOW`` neighbours on both sides, in double precision,
and verified pairs are united across passes into components.

A pass leaves pairs unmet whose first hash is shared by more than a window. Such
vectors (unless they are one component by then) are grouped by single hashes in ``CROWD_PASSES`` further passes; a group larger than a block is centred
on its mean direction, which takes away what its members have in common, and
hashed afresh, again and again, until its parts fit a block. Groups are
compared whole, none is cut; those that no hash splits are compared block by block.

Links are then counted exactly inside the components. Members within half the
threshold's angle of the component's first vector (its core) are all linked with
each other, so only the others (its rim) are compared, block by block, with the
whole component; only sums leave a task. A tight group of any size costs no pairs.

Rows: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; neither do vectors of different lengths, nor rows with a null
``vec_id`` (their component is null). Rows that repeat a ``vec_id`` count as
vectors of their own that share a component. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import hinted, stored
from foldwise.llm.graph import components

COSINE = 0.9
PASSES = 12
HASHES = 4
WINDOW, BLOCK = 64, 512
#: Groupings of crowded vectors; fresh hashes of a centred group and how often it is hashed below the first level; levels.
CROWD_PASSES, CROWD_HASHES, CROWD_TRIES, CROWD_LEVELS = 48, 1, 4, 6
#: Members whose mean is a group's centre, about; any centre gives right links.
CENTRE = 64


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length one in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # first: squares of very large or small numbers
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _rotation(d: int, which: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([20_241, d, which]).standard_normal((d, d)))[0]


def _keys(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
    """``(dim, pass, key, cls)`` of every class and pass."""
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            unit = _unit(batch.column("embedding").take(pa.array(at)))
            cls = batch.column("cls").take(pa.array(at))
            for p in range(passes):
                key = np.zeros(len(at), np.int64)
                for k in range(HASHES):
                    turned = unit @ _rotation(int(d), p * HASHES + k)
                    top = np.abs(turned).argmax(axis=1)
                    sign = turned[np.arange(len(at)), top] < 0
                    key = key * np.int64(2 * d) + 2 * top + sign
                same = lambda v: pa.array(np.full(len(at), v, np.int32))
                yield pa.RecordBatch.from_arrays([same(d), same(p), pa.array(key), cls], names=["dim", "pass", "key", "cls"])


def _hashed(unit: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Cross-polytope hash of each row."""
    turned = unit @ rotation
    top = np.abs(turned).argmax(axis=1)
    return 2 * top + (turned[np.arange(len(unit)), top] < 0)


def _coarse(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
    """``(pass, key, dim, cls, root)`` by one hash in every pass."""
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for d in np.unique(dims):
            at = pa.array(np.flatnonzero(dims == d))
            unit = _unit(batch.column("embedding").take(at))
            dim, cls, root = (batch.column(c).take(at) for c in ("dim", "cls", "root"))
            for p in range(passes):
                key = _hashed(unit, _rotation(int(d), 1_000_000 + p))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(key, pa.int64()), dim, cls, root], names=["pass", "key", "dim", "cls", "root"])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(grp, centre)``: mean direction of the vectors of each list."""
    for batch in batches:
        lists = batch.column("vectors")
        at = np.asarray(lists.offsets)
        means = [_unit(lists.values.slice(a, b - a)).mean(axis=0) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(means, pa.list_(pa.float64()))], names=["grp", "centre"])


def _centred(batches: Iterator[pa.RecordBatch], level: int, tries: int) -> Iterator[pa.RecordBatch]:
    """``(grp, pass, key, cls, root)``: fresh hashes of what sets each vector apart from its group's centre."""
    for batch in batches:
        dims, passes = np.asarray(batch.column("dim")), np.asarray(batch.column("pass"))
        for d in np.unique(dims):
            for p in np.unique(passes[dims == d]):
                at = pa.array(np.flatnonzero((dims == d) & (passes == p)))
                centre = batch.column("centre").take(at)
                rest = _unit(batch.column("embedding").take(at)) - np.asarray(centre.flatten()).reshape(len(at), -1)
                grp, cls, root = (batch.column(c).take(at) for c in ("grp", "cls", "root"))
                for t in range(tries):
                    now, key = int(p) * tries + t, np.zeros(len(at), np.int64)
                    for k in range(CROWD_HASHES):
                        key = key * np.int64(2 * d) + _hashed(rest, _rotation(int(d), (1 + level) * 1_000_000 + now * CROWD_HASHES + k))
                    yield pa.RecordBatch.from_arrays([grp, pa.array(np.full(len(at), now, np.int32)), pa.array(key), cls, root], names=["grp", "pass", "key", "cls", "root"])


def _united(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Verified links of each block as ``(id, smallest id of its local group)``."""
    for batch in batches:
        left, right = [], []
        lists = batch.column(0)
        at = np.asarray(lists.offsets)
        for a, b in zip(at[:-1], at[1:]):
            rows = lists.values.slice(a, b - a)
            group = np.asarray(rows.field("dim")).astype(np.int64) << 32 | np.asarray(rows.field("pass"))
            ids = np.asarray(rows.field("rep"))
            for g in np.unique(group):
                of = np.flatnonzero(group == g)
                unit = _unit(rows.field("embedding").take(pa.array(of)))
                i, j = np.nonzero(unit @ unit.T >= cosine)
                root = ids[of].copy()
                while True:  # smallest id over neighbours, then over the group so far
                    new = root.copy()
                    np.minimum.at(new, i, root[j])
                    if (new == root).all():
                        break
                    root = new
                keep = root != ids[of]
                left.append(ids[of][keep])
                right.append(root[keep])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left or [np.empty(0, np.int64)])), pa.array(np.concatenate(right or [np.empty(0, np.int64)]))], names=["u", "v"])


def _sums(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Copies linked with each class of a list: side 2 all with all, 0 with 1 crosswise."""
    for batch in batches:
        out_cls, out_n = [], []
        lists = batch.column(0)
        at = np.asarray(lists.offsets)
        for a, b in zip(at[:-1], at[1:]):
            rows = lists.values.slice(a, b - a)
            side, copies, cls, dims = (np.asarray(rows.field(c)) for c in ("side", "copies", "cls", "dim"))
            for d in np.unique(dims):
                one, two = np.flatnonzero((side != 1) & (dims == d)), np.flatnonzero((side != 0) & (dims == d))
                if not len(one) or not len(two):
                    continue
                links = _unit(rows.field("embedding").take(pa.array(one))) @ _unit(rows.field("embedding").take(pa.array(two))).T >= cosine
                links &= cls[one][:, None] != cls[two][None, :]
                out_cls.append(cls[one])
                out_n.append(links @ copies[two])
                if side[one[0]] != 2:
                    out_cls.append(cls[two])
                    out_n.append(copies[one] @ links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out_cls or [np.empty(0, np.int64)])), pa.array(np.concatenate(out_n or [np.empty(0, np.int64)]).astype(np.int64))], names=["cls", "n"]
        )


def _near_first(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Whether each class lies in the core around its component's first vector."""
    for batch in batches:
        dims, first_dims = np.asarray(batch.column("dim")), np.asarray(batch.column("first_dim"))
        core = np.zeros(len(dims), bool)
        for d in np.unique(dims):
            at = np.flatnonzero((dims == d) & (first_dims == d))
            if len(at):
                one, two = (_unit(batch.column(c).take(pa.array(at))) for c in ("embedding", "first"))
                core[at] = (one * two).sum(axis=1) >= least
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("root"), batch.column("copies"), batch.column("dim"), batch.column("embedding"), pa.array(core)], names=["cls", "root", "copies", "dim", "embedding", "core"])


def _listed(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.collect_list(F.struct(*fields)).alias("rows")).select("rows")


def _window_links(classes: DataFrame, cosine: float, passes: int) -> tuple[DataFrame, DataFrame]:
    """Links found in the overlapping blocks of all passes' orders, and the keys ``(dim, pass, key, cls)``."""
    keys = classes.select("dim", "embedding", "cls").mapInArrow(lambda it: _keys(it, passes), "dim int, pass int, key long, cls long")
    order = ["dim", "pass", "key", "tie"]
    keys = keys.withColumn("tie", F.xxhash64("cls", "pass"))
    parts = max(2, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    # The id's low 33 bits are the place in its partition, the others the partition.
    ordered = stored(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("tie"), "order")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # One number for each partition.
    sizes = {r["part"]: r["n"] for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [0] * (max(sizes, default=-1) + 1), 0
    for p in range(len(starts)):
        starts[p], total = total, total + sizes.get(p, 0)
    rank = F.get(F.lit(starts or [0]), part.cast("int")).cast("long") + place
    own = F.floor(rank / BLOCK)
    blocks = F.when((rank % BLOCK < WINDOW) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    rows = ordered.select("pass", "cls", F.explode(blocks).alias("block")).join(classes.select("cls", "rep", "dim", "embedding"), "cls")
    lists = _listed(rows, ["block"], ["pass", "dim", "rep", "embedding"])
    return lists.mapInArrow(lambda it: _united(it, cosine), "u long, v long").distinct(), ordered.select("dim", "pass", "key", "cls")


def _crowd_links(classes: DataFrame, keys: DataFrame, links: DataFrame, cosine: float) -> DataFrame | None:
    """Links among vectors whose keys fill more than a window, or None if there are none such."""
    # Vectors that share the first hash alone are near in the order only if they are few.
    first = keys.select("dim", "pass", F.expr(f"key div cast(power(2 * dim, {HASHES - 1}) as bigint)").alias("key"), "cls")
    full = stored(first.groupBy("dim", "pass", "key").agg(F.count("*").alias("n")).where(F.col("n") > WINDOW).drop("n"), "full")
    if not full.limit(1).count():
        return None
    roots = classes.select("cls", "rep").join(components(links).withColumnRenamed("id", "rep"), "rep", "left").select("cls", F.coalesce("root", "rep").alias("root"))
    inside = stored(first.join(hinted(full, 20_000), ["dim", "pass", "key"]).join(stored(roots, "class_roots"), "cls"), "inside")
    mixed = stored(inside.groupBy("dim", "pass", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("dim", "pass", "key"), "mixed")
    several = inside.join(hinted(mixed, 20_000), ["dim", "pass", "key"]).select("cls", "root").distinct()
    crowd = stored(several.join(classes.select("cls", "rep", "dim", "embedding"), "cls"), "crowd")
    if not crowd.limit(1).count():
        return None
    vectors = crowd.select("cls", "rep", "dim", "embedding")
    found = []
    units = crowd.select("dim", "embedding", "cls", "root").mapInArrow(lambda it: _coarse(it, CROWD_PASSES), "pass int, key long, dim int, cls long, root long")
    rows = units.select("pass", F.xxhash64("dim", "pass", "key").alias("grp"), "cls", "root")
    for level in range(1, CROWD_LEVELS + 2):
        rows = stored(rows, "groups")
        sizes = stored(rows.groupBy("grp").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("grp", "n"), "sizes")
        small = rows.join(sizes.where(F.col("n") <= BLOCK), "grp").join(vectors, "cls")
        lists = _listed(small, ["grp"], ["pass", "dim", "rep", "embedding"])
        found.append(stored(lists.mapInArrow(lambda it: _united(it, cosine), "u long, v long").distinct(), "found"))
        large = sizes.where(F.col("n") > BLOCK)
        if not large.limit(1).count():
            break
        large_rows = rows.join(hinted(large, 20_000), "grp")
        if level > CROWD_LEVELS:  # hashes do not split them: every block meets every block
            parts = F.ceil(F.col("n") / BLOCK).cast("int")
            own = F.pmod(F.xxhash64("cls"), parts)
            met = large_rows.select("pass", "grp", "cls", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
            met = met.select("pass", "grp", "cls", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
            lists = _listed(met.join(vectors, "cls"), ["grp", "x", "y"], ["pass", "dim", "rep", "embedding"])
            found.append(stored(lists.mapInArrow(lambda it: _united(it, cosine), "u long, v long").distinct(), "found"))
            break
        few = F.pmod(F.xxhash64("grp", "cls"), F.ceil(F.col("n") / CENTRE)) == 0
        centres = large_rows.where(few).join(vectors.select("cls", "embedding"), "cls").groupBy("grp").agg(F.collect_list("embedding").alias("vectors"))
        centres = stored(centres.mapInArrow(_centres, "grp long, centre array<double>"), "centres")
        both = large_rows.drop("n").join(vectors, "cls").join(hinted(centres, 5_000), "grp", "left")
        zero = F.array_repeat(F.lit(0.0), F.col("dim"))
        both = both.select("grp", "pass", "cls", "root", "dim", "embedding", F.coalesce("centre", zero).alias("centre"))
        tries = 1 if level == 1 else CROWD_TRIES
        again = both.mapInArrow(lambda it, level=level, tries=tries: _centred(it, level, tries), "grp long, pass int, key long, cls long, root long")
        rows = again.select("pass", F.xxhash64("grp", "pass", "key").alias("grp"), "cls", "root")
    return reduce(DataFrame.unionAll, found).distinct()


def _link_counts(classes: DataFrame, roots: DataFrame, cosine: float) -> DataFrame:
    """``(cls, linked)``: copies of other classes of its component linked with each class."""
    members = classes.join(roots.withColumnRenamed("id", "rep"), "rep")
    firsts = members.where("rep = root").groupBy("root").agg(F.min_by(F.struct("embedding", "dim"), "cls").alias("f"))
    firsts = firsts.select("root", F.col("f.embedding").alias("first"), F.col("f.dim").alias("first_dim"))
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    kind = dict(classes.dtypes)["embedding"]
    cored = stored(
        members.join(firsts, "root").mapInArrow(lambda it: _near_first(it, half), f"cls long, root long, copies long, dim int, embedding {kind}, core boolean"), "cored"
    )
    shape = cored.groupBy("root").agg(
        F.sum(F.col("core").cast("long")).alias("cores"), F.sum((~F.col("core")).cast("long")).alias("rims"), F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_copies")
    )
    rows = cored.join(shape, "root")
    sure = rows.where("core").select("cls", (F.col("core_copies") - F.col("copies")).alias("n"))
    core_parts, rim_parts = F.ceil(F.col("cores") / BLOCK).cast("int"), F.ceil(F.col("rims") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("core"), core_parts).otherwise(rim_parts)).cast("int")
    some = rows.where("rims > 0").select("root", "cls", "copies", "dim", "embedding", "core", own.alias("own"), core_parts.alias("core_parts"), rim_parts.alias("rim_parts"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias("other")
    # List names: (block of the rim, block met); core blocks count down from -1.
    base = ["root", "cls", "copies", "dim", "embedding"]
    from_core = some.where("core").select(*base, "own", upto("rim_parts")).select(*base, F.col("other").alias("x"), (-1 - F.col("own")).alias("y"), F.lit(1).alias("side"))
    to_core = some.where("not core and core_parts > 0").select(*base, "own", upto("core_parts")).select(*base, F.col("own").alias("x"), (-1 - F.col("other")).alias("y"), F.lit(0).alias("side"))
    rim = some.where("not core").select(*base, "own", upto("rim_parts"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    in_rim = rim.select(*base, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"))
    lists = _listed(from_core.unionAll(to_core).unionAll(in_rim), ["root", "x", "y"], ["cls", "copies", "dim", "embedding", "side"])
    compared = lists.mapInArrow(lambda it: _sums(it, cosine), "cls long, n long")
    return sure.unionAll(compared).groupBy("cls").agg(F.sum("n").alias("linked"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    wide = F.transform("embedding", lambda x: x.cast("double"))
    poor = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce((F.size("embedding") > 0) & ~poor & F.exists(wide, lambda x: x != 0.0), F.lit(False)) & F.col("vec_id").isNotNull()
    good = rows.where(fine)
    classes = stored(
        good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")).withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    near, keys = _window_links(classes, cosine, passes)
    links = stored(near, "links")
    more = _crowd_links(classes, keys, links, cosine)
    links = links if more is None else links.unionAll(more)
    same = good.select("vec_id", "embedding").join(classes.select("embedding", "rep", "cls", "copies"), "embedding").select("vec_id", "rep", "cls", "copies")
    member = stored(same, "member")
    roots = stored(components(links.unionAll(member.where("vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v")))), "roots")
    counts = _link_counts(classes, roots, cosine)
    of_class = classes.select("cls").join(counts, "cls", "left").select("cls", F.coalesce("linked", F.lit(0)).alias("linked"))
    good_rows = member.join(of_class, "cls").select("vec_id", (F.col("copies") - 1 + F.col("linked")).cast("long").alias("n_links"))
    poor_rows = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    label = F.coalesce("root", "vec_id")
    out = good_rows.unionAll(poor_rows).join(roots.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return out.select("vec_id", "n_links", label.alias("component_id"), F.coalesce(label == F.col("vec_id"), F.lit(True)).alias("kept"))
