"""Out-of-fold jobs over Spark ML estimators.

``run_oof`` fits one model per (repeat, fold) on the other folds and scores all
rows in a single narrow pass: every row passes through all fitted models, a
training row keeps the ones that held it out and a test row averages all.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.keyed import keyed_hash, unit_noise
from ..functions.rowwise import add_all, clip, squared_error
from ..session import pin, stored
from .features import Roles, numeric_columns, structured_matrix
from .folds import N_FOLDS, inner_split
from .ranks import bin_of, exact_quantiles, quantile_edges

#: Adds one prediction column to a frame.
Scorer = Callable[[DataFrame, str], DataFrame]
#: Fits on the training part of a cell only.
FitFold = Callable[[DataFrame], Scorer]

MISSING = -1.0
PARALLEL_FITS = 4


def model_frame(frame: DataFrame, folds: DataFrame, target: str, roles: Roles = Roles(), years: bool = True,
                categories: bool = True, extra: DataFrame | None = None, extra_cols: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, split, y, folds, features): gaps are a constant plus a flag, so nothing is fitted here.

    Categories are indexed on the training universe; unknown levels get their own index.
    """
    from .folds import fold_array

    matrix = structured_matrix(frame, roles, years=years)
    kept = [c for c in keep if c not in matrix.columns]
    base = matrix.join(frame.select(roles.key, "split", F.col(target).alias("y"), *kept), roles.key)
    if extra is not None:
        base = base.join(extra.select(roles.key, *extra_cols), roles.key, "left")
    numeric = [*numeric_columns(frame.columns, roles), *(roles.years if years else ()), *extra_cols]
    flags = [f"{c}_missing" for c in roles.nullable]
    base = base.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(f"_{c}") for c in numeric])
    inputs = [f"_{c}" for c in numeric] + flags
    if categories:
        index = StringIndexer(inputCols=list(roles.categories), outputCols=[f"{c}_ix" for c in roles.categories], handleInvalid="keep",
                              stringOrderType="alphabetAsc").fit(base.filter("split = 'train'"))
        base = index.transform(base)
        inputs += [f"{c}_ix" for c in roles.categories]
    vector = VectorAssembler(inputCols=inputs, outputCol="features").transform(base)
    return vector.join(fold_array(folds, roles.key), roles.key, "left").select(roles.key, "split", "y", "folds", "features", *keep)


def cell_training(data: DataFrame, repeat: int, fold: int) -> DataFrame:
    return data.filter((F.col("split") == "train") & (F.col("folds")[repeat] != fold))


def fit_all(data: DataFrame, fit: FitFold, n_repeats: int, n_folds: int = N_FOLDS, parallel: int = PARALLEL_FITS) -> dict[tuple[int, int], Scorer]:
    """Fit every cell; independent fits run side by side on the cluster.

    A fit reads its rows several times, so they are kept in the executors until all cells are fitted.
    """
    cells = [(r, f) for r in range(n_repeats) for f in range(n_folds)]
    task = inheritable_thread_target(data.sparkSession)(lambda c: (c, fit(cell_training(data, *c))))
    with kept(data), ThreadPoolExecutor(parallel) as pool:
        return dict(pool.map(task, cells))


@contextmanager
def kept(data: DataFrame) -> Iterator[None]:
    """Keep a table that lies in files in the executors (memory, then disk) meanwhile; its rows keep their layout.

    The sampling of the trees depends on the layout, which a table still to be shuffled might change here.
    """
    held = hasattr(data, "stored_at") and not data.is_cached
    if held:
        data.persist()
    try:
        yield
    finally:
        if held:
            data.unpersist()


def score_cells(data: DataFrame, scorers: Mapping[tuple[int, int], Scorer], lo: float | None = 0.0, hi: float = 100.0) -> DataFrame:
    """One pass over all rows; adds ``pred`` (mean over repeats, or over all models for test rows).

    A training row passes through the models that held it out only, a test row through all.
    """
    keep = data.columns

    def scored(rows: DataFrame) -> DataFrame:
        for (r, f), scorer in scorers.items():
            rows = scorer(rows, f"_p{r}_{f}").select(*rows.columns, f"_p{r}_{f}")
        return rows

    repeats = sorted({r for r, _ in scorers})
    held = []
    for r in repeats:
        arms = F.lit(None).cast("double")
        for f in sorted(f for rr, f in scorers if rr == r):
            arms = F.when(F.col("folds")[r] == f, F.col(f"_p{r}_{f}")).otherwise(arms)
        held.append(arms)
    every = add_all([F.col(f"_p{r}_{f}") for r, f in scorers]) / len(scorers)
    lost = F.raise_error(F.lit("a training row is not held out once per repeat with a finite prediction"))
    own = F.col("_own")
    train = scored(data.filter("split = 'train'")).select(*keep, (add_all(held) / len(held)).alias("_own"))
    train = train.select(*keep, F.when(own.isNull() | F.isnan(own), lost).otherwise(own).alias("_pred"))
    test = scored(data.filter("split <> 'train'")).select(*keep, every.alias("_pred"))
    out = train.unionByName(test)
    return out.select(*keep, (F.col("_pred") if lo is None else clip("_pred", lo, hi)).alias("pred"))


def run_oof(data: DataFrame, fit: FitFold, n_repeats: int, n_folds: int = N_FOLDS, lo: float | None = 0.0, hi: float = 100.0) -> DataFrame:
    return score_cells(data, fit_all(data, fit, n_repeats, n_folds), lo, hi)


def quality(scored: DataFrame, name: str) -> DataFrame:
    """MSE per side next to the MSE of the training mean."""
    mean = scored.filter("split = 'train'").agg(F.avg("y")).scalar()
    base = scored.select("split", "y", "pred", mean.alias("m"))
    return base.groupBy("split").agg(F.count("*").alias("n"), F.avg(squared_error("y", "pred")).alias("mse"), F.avg(squared_error("y", "m")).alias("mse_of_mean")).withColumn("model", F.lit(name))


# ---- estimators ------------------------------------------------------------------

#: Small defaults; production runs raise rounds and depth.
TREES = dict(maxIter=10, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, seed=42)
MIN_BINS = 64


def bins_for(train: DataFrame) -> int:
    """Bins a tree needs: one for each level of the largest indexed category."""
    attrs = train.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    return max([MIN_BINS, *[len(a.get("vals", ())) + 1 for a in attrs.get("nominal", ())]])


def _ml_scorer(model) -> Scorer:
    return lambda df, out: model.copy({model.predictionCol: out}).transform(df)


def inner_validation(train: DataFrame, key: str = "row_id") -> DataFrame:
    """Mark one tenth of the training part for early stopping; the held-out fold is never used."""
    return train.withColumn("_val", (keyed_hash(key, 99) % 10) == 0)


def gbt(weight: str | None = None, early_stop: bool = False, **params) -> FitFold:
    """Boosted trees with squared loss, optionally weighted and early-stopped on an inner split."""
    def fit(train: DataFrame) -> Scorer:
        est = GBTRegressor(featuresCol="features", labelCol="y", **{**TREES, "maxBins": bins_for(train), **params})
        if weight:
            est = est.setWeightCol(weight)
        if early_stop:
            train, est = inner_validation(train), est.setValidationIndicatorCol("_val")
        return _ml_scorer(est.fit(train))

    return fit


#: A stop rule waits so many rounds for a better validation error.
PATIENCE = 5


def staged_losses(model, rows: DataFrame, weight: str | None = None) -> np.ndarray:
    """(Weighted) squared error after each round of a boosted model, all rounds in one pass over the rows."""
    w, names = F.lit(1.0) if weight is None else F.col(weight), rows.columns
    out = rows
    for i, tree in enumerate(model.trees):
        out = tree.copy({tree.predictionCol: f"_t{i}"}).transform(out).select(*names, *[f"_t{j}" for j in range(i + 1)])
    pred, sums = F.lit(0.0), []
    for i, share in enumerate(model.treeWeights):
        pred = pred + F.lit(float(share)) * F.col(f"_t{i}")
        sums.append((F.sum(w * (F.col("y") - pred) * (F.col("y") - pred)) / F.sum(w)).alias(f"l{i}"))
    return np.array(out.agg(*sums).first(), dtype=float)


def best_round(losses: np.ndarray, patience: int = PATIENCE) -> int:
    """Rounds kept by the stop rule: the best one before ``patience`` rounds pass without a better one."""
    best = 0
    for i in range(1, len(losses)):
        if losses[i] < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def staged_gbt(weight: str | None = None, patience: int = PATIENCE, **params) -> FitFold:
    """Boosted trees cut at the best round of an inner validation part, whose error carries the weights as the fit does."""
    def fit(train: DataFrame) -> Scorer:
        marked = inner_validation(train)
        est = GBTRegressor(featuresCol="features", labelCol="y", **{**TREES, "maxIter": 30, "maxBins": bins_for(train), **params})
        if weight:
            est = est.setWeightCol(weight)
        model = est.fit(marked.filter(~F.col("_val")))
        losses = staged_losses(model, marked.filter("_val"), weight)
        keep = best_round(losses, patience)
        trees, shares, whole = model.trees[:keep], model.treeWeights[:keep], _ml_scorer(model)

        def score(df: DataFrame, out: str) -> DataFrame:
            names = df.columns
            if keep == len(losses):  # no round is cut: the model scores a row at once
                return whole(df, out)
            for i, tree in enumerate(trees):
                df = tree.copy({tree.predictionCol: f"_t{i}"}).transform(df).select(*names, *[f"_t{j}" for j in range(i + 1)])
            return df.select(*names, add_all([F.lit(float(s)) * F.col(f"_t{i}") for i, s in enumerate(shares)]).alias(out))

        score.entry = (len(losses), keep, float(losses[keep - 1]))
        return score

    return fit


def rounds_ledger(scorers: Mapping[tuple[int, int], Scorer]) -> list[tuple[int, int, int, int, float]]:
    """(repeat, fold, rounds tried, rounds kept, validation error) of every cell's staged fit."""
    return [(r, f, *s.entry) for (r, f), s in sorted(scorers.items())]


def forest(**params) -> FitFold:
    opts = {**dict(numTrees=20, maxDepth=6, seed=42, featureSubsetStrategy="onethird"), **params}
    return lambda train: _ml_scorer(RandomForestRegressor(featuresCol="features", labelCol="y", **{"maxBins": bins_for(train), **opts}).fit(train))


def huber_boost(alpha: float = 5.0, rounds: int = 8, rate: float = 0.3, depth: int = 4, min_rows: int = 1, cut_every: int = 8) -> FitFold:
    """Boosting on residuals clipped to +-alpha; the running fit is kept a round, and written out every few rounds."""
    def fit(train: DataFrame) -> Scorer:
        start = float(train.agg(F.avg("y").alias("m")).first()["m"])
        trees, current, before = [], train.select("features", "y", F.lit(start).alias("_f")), None
        for i in range(rounds):
            if i:  # the passes of a round score each row once, by the last tree
                current.persist()
            target = current.withColumn("_r", clip(F.col("y") - F.col("_f"), -alpha, alpha))
            tree = DecisionTreeRegressor(featuresCol="features", labelCol="_r", maxDepth=depth, minInstancesPerNode=min_rows, maxBins=bins_for(train), seed=42 + i).fit(target)
            trees.append(tree)
            if before is not None:
                before.unpersist()
            before = current if i else None
            step = tree.copy({tree.predictionCol: "_t"}).transform(current)
            current = step.select("features", "y", (F.col("_f") + rate * F.col("_t")).alias("_f"))
            if (i + 1) % cut_every == 0 and i + 1 < rounds:
                current = pin(current)
        if before is not None:
            before.unpersist()

        def score(df: DataFrame, out: str) -> DataFrame:
            names = df.columns
            for j, tree in enumerate(trees):
                df = tree.copy({tree.predictionCol: f"_h{j}"}).transform(df)
            total = add_all([F.lit(start), *[rate * F.col(f"_h{j}") for j in range(len(trees))]])
            return df.select(*names, total.alias(out))

        return score

    return fit


def bagged(make: Callable[[int], FitFold], seeds: Sequence[int]) -> FitFold:
    """Mean of the same estimator under several seeds."""
    def fit(train: DataFrame) -> Scorer:
        parts = [make(s)(train) for s in seeds]

        def score(df: DataFrame, out: str) -> DataFrame:
            names = df.columns
            for i, p in enumerate(parts):
                df = p(df, f"_s{i}").select(*names, *[f"_s{j}" for j in range(i)], f"_s{i}")
            return df.select(*names, (add_all([F.col(f"_s{i}") for i in range(len(parts))]) / len(parts)).alias(out))

        return score

    return fit


def _probability(model, position: int) -> Scorer:
    def score(df: DataFrame, out: str) -> DataFrame:
        names = df.columns
        done = model.copy({model.predictionCol: "_cp", model.rawPredictionCol: "_cr", model.probabilityCol: "_cb"}).transform(df)
        return done.select(*names, vector_to_array("_cb")[position].alias(out))

    return score


def classifier(**params) -> FitFold:
    """Probability of y = 1 from boosted trees."""
    opts = {**dict(maxIter=8, maxDepth=3, stepSize=0.3, seed=42), **params}
    return lambda train: _probability(GBTClassifier(featuresCol="features", labelCol="y", **{"maxBins": bins_for(train), **opts}).fit(train), 1)


def binned(bins: int, regress: bool, hard: bool = False, min_rows: int = 200) -> FitFold:
    """Two-stage model: class probabilities of target bins, then bin centres or per-bin regressors.

    With ``regress`` every bin with enough rows has its own tree (else the bin
    centre); routing is soft (sum of p times value) or hard (most likely bin).
    """
    def fit(train: DataFrame) -> Scorer:
        edges = quantile_edges(train, "y", bins, (0.0, 100.0))
        labelled = train.withColumn("_bin", bin_of("y", edges).cast("double"))
        clf = RandomForestClassifier(featuresCol="features", labelCol="_bin", numTrees=15, maxDepth=5, maxBins=bins_for(train), seed=42).fit(labelled)
        ends = labelled.groupBy("_bin").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("n")).collect()
        stats = {int(r["_bin"]): ((r["lo"] + r["hi"]) / 2, r["n"]) for r in ends}
        local = {}
        if regress:
            for b, (_, n) in stats.items():
                if n >= min_rows:
                    local[b] = DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=3, maxBins=bins_for(train), seed=42).fit(labelled.filter(F.col("_bin") == b))

        def score(df: DataFrame, out: str) -> DataFrame:
            names = df.columns
            done = clf.copy({clf.predictionCol: "_cp", clf.rawPredictionCol: "_cr", clf.probabilityCol: "_cb"}).transform(df)
            for b, tree in local.items():
                done = tree.copy({tree.predictionCol: f"_l{b}"}).transform(done)
            value = {b: F.col(f"_l{b}") if b in local else F.lit(float(m)) for b, (m, _) in stats.items()}
            prob = vector_to_array("_cb")
            if hard:
                pred = F.lit(None).cast("double")
                for b, v in value.items():
                    pred = F.when(F.col("_cp") == b, v).otherwise(pred)
            else:
                pred = add_all([prob[b] * v for b, v in value.items()])
            return done.select(*names, pred.alias(out))

        return score

    return fit


def clustered(k: int = 4, min_rows: int = 500) -> FitFold:
    """k-means on the scaled training part, one tree per cluster, the global tree for thin clusters."""
    def fit(train: DataFrame) -> Scorer:
        scaler = StandardScaler(inputCol="features", outputCol="_z", withMean=True, withStd=True).fit(train)
        means = KMeans(featuresCol="_z", predictionCol="_k", k=k, seed=42, maxIter=10).fit(scaler.transform(train))
        km = PipelineModel([scaler, means])
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=5, maxBins=bins_for(train), seed=42)
        overall, tagged = tree.fit(train), stored(km.transform(train).select("features", "y", "_k"), "clusters")
        sizes = {r["_k"]: r["n"] for r in tagged.groupBy("_k").agg(F.count("*").alias("n")).collect()}
        local = {c: tree.fit(tagged.filter(F.col("_k") == c)) for c, n in sizes.items() if n >= min_rows}

        def score(df: DataFrame, out: str) -> DataFrame:
            names = df.columns
            done = overall.copy({overall.predictionCol: "_g"}).transform(km.transform(df))
            pred = F.col("_g")
            for c, m in local.items():
                done = m.copy({m.predictionCol: f"_c{c}"}).transform(done)
                pred = F.when(F.col("_k") == c, F.col(f"_c{c}")).otherwise(pred)
            return done.select(*names, pred.alias(out))

        return score

    return fit


def pseudo_labelled(data: DataFrame, base: FitFold, labelers: Sequence[FitFold], weight: float, keep: float = 1.0) -> FitFold:
    """Add test rows to every training part, labelled by the blend of ``labelers`` fitted on that part alone.

    ``keep`` is the share of test rows that take part, those on which the labelers agree most.
    """
    test = data.filter("split = 'test'").drop("y")

    def fit(train: DataFrame) -> Scorer:
        names, marked = [f"_l{i}" for i in range(len(labelers))], test
        for name, make in zip(names, labelers):
            marked = make(train)(marked, name).select(*test.columns, *[n for n in names if n <= name])
        spread = F.array_max(F.array(*names)) - F.array_min(F.array(*names))
        marked = pin(marked.select(*test.columns, (add_all([F.col(n) for n in names]) / len(names)).alias("y"), spread.alias("_gap")))
        if keep < 1.0:
            cut = exact_quantiles(marked, "_gap", [keep]).first()["q0"]
            marked = marked.filter(F.col("_gap") <= (cut if cut is not None else 0.0))
        extra = marked.withColumn("_w", F.lit(weight))
        return base(train.withColumn("_w", F.lit(1.0)).unionByName(extra.select(*train.columns, "_w")))

    return fit


def two_stage(data: DataFrame, first: FitFold, second: FitFold, target: Callable[[Column, Column], Column], n_repeats: int,
              n_folds: int = N_FOLDS, n_inner: int = 3, parallel: int = PARALLEL_FITS) -> DataFrame:
    """``row_id, split, y, p1, p2``: a second model on what the first leaves, fitted inside every cell.

    Within the training part of a cell the first model is fitted out of fold over an
    inner split, so the second one learns from honest first predictions, and neither has seen
    the cell's held-out rows. Held-out rows take the mean of the inner first models.
    """
    cells = [(r, f) for r in range(n_repeats) for f in range(n_folds)]
    base = ["row_id", "split", "y", "folds", "features"]

    def one(cell: tuple[int, int]) -> DataFrame:
        r, f = cell
        train = cell_training(data, r, f).select(*base).withColumn("_inner", inner_split("row_id", 42, r, n_inner))
        models = [first(train.filter(F.col("_inner") != i).drop("_inner")) for i in range(n_inner)]

        def scored(df: DataFrame) -> DataFrame:
            for i, m in enumerate(models):
                df = m(df, f"_f{i}").select(*df.columns, f"_f{i}")
            return df

        each = F.array(*[F.col(f"_f{i}") for i in range(n_inner)])
        staged = pin(scored(train).select(*base, each[F.col("_inner")].alias("p1")).withColumn("y", target(F.col("y"), F.col("p1"))).drop("p1"))
        last = second(staged)
        rest = data.select(*base).filter((F.col("split") != "train") | (F.col("folds")[r] == f))
        mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / n_inner
        out = last(scored(rest).select(*base, mean.alias("p1")), "p2")
        return pin(out.select("row_id", "split", "y", "p1", "p2"))

    task = inheritable_thread_target(data.sparkSession)(one)
    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(task, cells))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("row_id", "split").agg(F.first("y").alias("y"), F.avg("p1").alias("p1"), F.avg("p2").alias("p2"))


def augmented(base: FitFold, make: Callable[[DataFrame], DataFrame]) -> FitFold:
    """Extend the training part by rows derived from it alone."""
    return lambda train: base(train.select("features", "y", "row_id").unionByName(make(train).select("features", "y", "row_id")))


def jittered(train: DataFrame, n_numeric: int, scale: float, noise_seed: int) -> DataFrame:
    """Copies whose numeric features carry keyed Gaussian noise of ``scale`` standard deviations.

    The deviations are those of the training part alone; gaps stay gaps and the
    target stays. A normal number is made from two keyed uniforms (Box-Muller).
    """
    from pyspark.ml.functions import array_to_vector

    from ..functions.keyed import unit_uniform

    x = train.select("row_id", "y", vector_to_array("features").alias("x"))
    value = lambda i: F.when(F.col("x")[i] != MISSING, F.col("x")[i])
    stds = x.agg(F.array(*[F.coalesce(F.stddev_pop(value(i)), F.lit(0.0)) for i in range(n_numeric)]).alias("s")).scalar()
    own = F.col("row_id") * 131

    def moved(v: Column, i: Column) -> Column:
        radius = F.sqrt(-2.0 * F.log(F.greatest(unit_uniform(own + i, noise_seed), F.lit(1e-12))))
        normal = radius * F.cos(2.0 * math.pi * unit_uniform(own + i, noise_seed + 1))
        return F.when((i < n_numeric) & (v != MISSING), v + scale * F.col("s")[i] * normal).otherwise(v)

    return x.select("*", stds.alias("s")).select("row_id", "y", array_to_vector(F.transform("x", moved)).alias("features"))


def beta_share(key: Column, shape: float, seed: int, tries: int = 12) -> Column:
    """A keyed Beta(shape, shape) number by Johnk's method: the first of some tries that is accepted."""
    from ..functions.keyed import unit_uniform

    found = []
    for t in range(tries):
        x, y = (F.pow(F.greatest(unit_uniform(key * 64 + 2 * t + i, seed), F.lit(1e-12)), F.lit(1.0 / shape)) for i in (0, 1))
        found.append(F.when((x + y <= 1.0) & (x + y > 0), x / (x + y)))
    return F.coalesce(*found, F.lit(0.5))


def mixed_up(train: DataFrame, n_numeric: int, seed: int = 3, shape: float = 0.4) -> DataFrame:
    """Convex combinations of a row and a partner chosen by a keyed shuffle, with Beta shares.

    Only the leading numeric positions are mixed; flags and codes stay the row's own.
    Both sides are numbered along two keyed orders and joined on the number, so
    every row has exactly one partner.
    """
    from pyspark.ml.functions import array_to_vector

    from ..functions.keyed import PRIME
    from .ranks import row_numbers

    slim = train.select("row_id", "y", vector_to_array("features").alias("x"))
    a = row_numbers(slim.withColumn("h", keyed_hash("row_id", seed)), [], "h", "row_id", (0, PRIME))
    b = row_numbers(slim.withColumn("h", keyed_hash("row_id", seed + 1)), [], "h", "row_id", (0, PRIME))
    both = a.join(b.select("rn", F.col("y").alias("y2"), F.col("x").alias("x2")), "rn").withColumn("lam", beta_share(F.col("row_id"), shape, seed + 2))
    lam = F.greatest("lam", 1.0 - F.col("lam"))  # the row keeps the larger share, as its flags and codes are its own
    mixed = F.transform("x", lambda p, i: F.when(i < n_numeric, p * lam + F.col("x2")[i] * (1 - lam)).otherwise(p))
    return both.select("row_id", array_to_vector(mixed).alias("features"), (lam * F.col("y") + (1 - lam) * F.col("y2")).alias("y"))


def neighbour_mixed(train: DataFrame, n_numeric: int, seed: int = 23, tail: float | None = None, k: int = 5) -> DataFrame:
    """Points between a row and one of its k nearest other training rows (all rows, or the low tail only).

    Distances are taken on numbers scaled by the training part's own deviations.
    """
    from pyspark.ml.functions import array_to_vector

    from ..functions.keyed import unit_uniform
    from .neighbours import exact_knn

    pool = train if tail is None else train.filter(F.col("y") <= tail)
    slim = pin(pool.select(F.col("row_id").alias("id"), "y", vector_to_array("features").alias("x"), F.lit(0).alias("g")))
    scale = slim.agg(F.array(*[F.coalesce(F.nullif(F.stddev_pop(F.col("x")[i]), F.lit(0.0)), F.lit(1.0)) for i in range(n_numeric)]).alias("s")).first()["s"]
    unit = F.array(*[F.lit(float(v)) for v in scale])
    refs = pin(slim.withColumn("vec", F.zip_with(F.slice("x", 1, n_numeric), unit, lambda v, s: v / s)))
    pairs = exact_knn(refs.select("id", "vec", F.lit(-1).alias("g")), refs.select("id", "vec", "y", "g"), k + 1).filter(F.col("id") != F.col("ref_id"))
    near = pairs.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "ref_id", "y"))), 1, k).alias("near"))
    pick = F.col("near")[F.pmod(keyed_hash("id", seed + 1), F.size("near")).cast("int")]
    partner = near.select("id", pick.alias("p")).select("id", F.col("p.ref_id").alias("ref_id"), F.col("p.y").alias("y2"))
    both = refs.select("id", "y", "x").join(partner, "id").join(refs.select(F.col("id").alias("ref_id"), F.col("x").alias("x2")), "ref_id")
    lam = unit_uniform("id", seed)
    mixed = F.transform("x", lambda v, i: F.when(i < n_numeric, v * lam + F.col("x2")[i] * (1 - lam)).otherwise(v))
    return both.select(F.col("id").alias("row_id"), array_to_vector(mixed).alias("features"), (lam * F.col("y") + (1 - lam) * F.col("y2")).alias("y"))


def masked(train: DataFrame, n_numeric: int, share: float = 0.15, seed: int = 17) -> DataFrame:
    """Copies with a keyed part of the numeric features set to the missing constant."""
    from pyspark.ml.functions import array_to_vector

    x = vector_to_array("features")
    cut = int(share * 1000)
    hit = lambda v, i: F.when((i < n_numeric) & ((keyed_hash(F.col("row_id") * 131 + i, seed) % 1000) < cut), F.lit(MISSING)).otherwise(v)
    return train.select("row_id", "y", array_to_vector(F.transform(x, hit)).alias("features"))


def null_targets(data: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """``data`` with ``nulls``: the target under ``draws`` keyed shuffles of the rows.

    Rows are numbered once along a keyed order; a draw sends the target of number i to number
    (a * i + b) mod n, with a and n without a common divisor, so that one grouping moves
    the targets of all draws.
    """
    from ..functions.keyed import PRIME
    from .ranks import row_numbers

    here = pin(row_numbers(data.withColumn("h", keyed_hash("row_id", seed)), [], "h", "row_id", (0, PRIME)).drop("h"))
    n = here.count()
    rng = random.Random(seed)
    steps = []
    while n and len(steps) < draws:
        a, b = rng.randrange(1, n + 1), rng.randrange(n)
        if math.gcd(a, n) == 1:
            steps.append((a, b))
    goals = F.array(*[F.pmod((F.col("rn") - 1) * F.lit(a) + F.lit(b), F.lit(max(n, 1))) for a, b in steps])
    moved = here.select("y", F.posexplode(goals).alias("draw", "at"))
    lists = moved.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "y"))), lambda e: e["y"]).alias("nulls"))
    return here.join(lists, F.col("rn") - 1 == F.col("at")).drop("rn", "at")


def null_importance(data: DataFrame, n_features: int, draws: int = 20, n_folds: int = N_FOLDS, parallel: int = PARALLEL_FITS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{fold: (importance, importance under each null draw)}, each from the training part of its cell."""
    def importance(train: DataFrame, label: str) -> np.ndarray:
        forest_ = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=8, maxDepth=5, maxBins=bins_for(train), seed=42)
        return forest_.fit(train).featureImportances.toArray()[:n_features]

    def one(fold: int) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
        train = cell_training(data, 0, fold).select("row_id", "y", "features")
        shuffled = stored(null_targets(train, draws, 1 + fold).select("y", "features", *[F.col("nulls")[i].alias(f"n{i}") for i in range(draws)]), "nulls")
        return fold, (importance(shuffled, "y"), np.array([importance(shuffled, f"n{i}") for i in range(draws)]))

    task = inheritable_thread_target(data.sparkSession)(one)
    with ThreadPoolExecutor(parallel) as pool:
        return dict(pool.map(task, range(n_folds)))


def correlation_drop(cov: np.ndarray, importance: np.ndarray, limit: float) -> dict[int, int]:
    """{column: the more important column it repeats}: greedy by importance, so every cluster keeps its best."""
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    corr = np.abs(cov / scale / scale[:, None])
    kept: list[int] = []
    dropped: dict[int, int] = {}
    for j in sorted(range(len(importance)), key=lambda i: (-importance[i], i)):
        near = [i for i in kept if corr[i, j] > limit]
        if near:
            dropped[j] = max(near, key=lambda i: corr[i, j])
        else:
            kept.append(j)
    return dropped


def permuted(data: DataFrame, seeds: Sequence[int], columns: int) -> DataFrame:
    """Every row once for each seed and feature position, with that feature taken from a partner row.

    A seed's keyed order pairs the rows for all columns at once: one join a seed.
    """
    from pyspark.ml.functions import array_to_vector

    from ..functions.keyed import PRIME
    from .ranks import row_numbers

    slim = data.select("row_id", "y", vector_to_array("features").alias("x"))
    here = pin(row_numbers(slim.withColumn("h", keyed_hash("row_id", 1)), [], "h", "row_id", (0, PRIME)).drop("h"))
    out = None
    for seed in seeds:
        other = row_numbers(slim.select("row_id", "x", keyed_hash("row_id", seed).alias("h")), [], "h", "row_id", (0, PRIME))
        both = here.join(other.select("rn", F.col("x").alias("_x2")), "rn").withColumn("seed", F.lit(seed))
        out = both if out is None else out.unionByName(both)
    each = out.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    x = F.transform("x", lambda v, i: F.when(i == F.col("position"), F.col("_x2")[i]).otherwise(v))
    return each.select("row_id", "y", "seed", "position", array_to_vector(x).alias("features"))


def spline_basis(columns: Sequence[str], knots: Mapping[str, Sequence[float]]) -> dict[str, Column]:
    """Linear, squared and hinge terms per column, gaps as zero."""
    out = {}
    for c in columns:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        out[f"{c}_1"], out[f"{c}_2"] = v, v * v
        for i, k in enumerate(knots.get(c, ())):
            out[f"{c}_h{i}"] = F.greatest(v - k, F.lit(0.0))
    return out
