"""The model search in few scans: moments of every group once, and all L1 fits of all folds in one solver.

Training rows of a fold are all groups but some, so sums and products of scaled features are added up once a group and
the groups left out are taken away again. What :func:`tessera.operators.model.train` does before the classifier is
then linear: centring, scaling and components of a fold are one matrix on row-scaled features. The classifiers of all
folds, numbers of components and strengths advance together: a scan of the rows sums the gradients of all of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.stage import stage_table


@dataclass(frozen=True)
class Fold:
    """Trained on the rows whose group in the *part*-th column of groups isn't in *out*."""

    part: int
    out: frozenset


@dataclass
class Space:
    """From row-scaled features to scaled components of a fold: ``(x[kept] - mean) @ matrix[:, :k]``."""

    kept: tuple[int, ...]
    n: int
    weights: dict  # of the groups
    mean: np.ndarray
    matrix: np.ndarray
    shares: np.ndarray
    gram: np.ndarray  # weighted second moments of all components, with the constant last

    def needed(self, variance: float) -> int:
        """The fewest components that explain *variance*."""
        total = np.cumsum(self.shares)
        return int(min(len(total), np.searchsorted(total, variance) + 1))


@dataclass
class Fit:
    """A classifier of a fold: coefficients of its components, and intercept."""

    fold: Fold
    k: int
    strength: float
    beta: np.ndarray
    intercept: float

    def linear(self, space: Space) -> tuple[np.ndarray, float]:
        """Coefficients of the row-scaled features, and constant."""
        u = space.matrix[:, : self.k] @ self.beta
        return u, self.intercept - float(space.mean @ u)


class Scans:
    """Rows as matrices, block by block, and how often they were scanned. Groups weigh alike in a fold if *balanced*."""

    def __init__(self, rows: DataFrame, groups: list[str], balanced: bool = True, block: int = 4096):
        width = rows.select(F.max(F.size("features"))).first()[0] or 0

        def matrices(part: Iterable) -> Iterable:
            held: list = []
            for r in part:
                held.append(r)
                if len(held) == block:
                    yield make(held)
                    held = []
            if held:
                yield make(held)

        def make(held: list) -> tuple:
            x = np.array([r[1] for r in held], float).reshape(len(held), width)
            return [r[0] for r in held], np.array([r[2] for r in held], float), [[r[3 + i] for r in held] for i in range(len(groups))], x

        self.spark, self.id_type = rows.sparkSession, rows.schema["sample_id"].dataType.simpleString()
        self.groups, self.balanced, self.width, self.scans = groups, balanced, width, 0
        self.blocks = rows.select("sample_id", "features", "y", *groups).rdd.mapPartitions(matrices).persist(StorageLevel.MEMORY_AND_DISK)

    def sum(self, f):
        """Sum over blocks of what *f* makes of each, a dictionary of arrays."""
        self.scans += 1

        def add(a: dict, b: dict) -> dict:
            return {k: a[k] + b[k] if k in a and k in b else a[k] if k in a else b[k] for k in a.keys() | b.keys()}

        return self.blocks.map(f).treeAggregate({}, add, add)

    def close(self) -> None:
        self.blocks.unpersist()


def scaled(x: np.ndarray, kept: tuple[int, ...]) -> np.ndarray:
    """Kept features of each row less their mean over their population deviation; centred only if that is 0."""
    x = x[:, list(kept)]
    x = x - x.mean(axis=1, keepdims=True) if x.shape[1] else x
    sd = np.sqrt((x * x).mean(axis=1, keepdims=True)) if x.shape[1] else 1.0
    return x / np.where(sd > 0, sd, 1.0)


def _by_group(names: list, values: np.ndarray) -> dict:
    where = np.array(names, dtype=object)
    return {g: values[where == g] for g in dict.fromkeys(names)}


class _Ends:
    """Least and largest values; they add up as such."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.lo, self.hi = lo, hi

    def __add__(self, o: _Ends) -> _Ends:
        return _Ends(np.minimum(self.lo, o.lo), np.maximum(self.hi, o.hi))


def spaces(data: Scans, folds: list[Fold]) -> dict[Fold, Space]:
    """The space of every fold from two scans (one more for each further set of features that vary in a fold)."""

    def ends(block):
        _, _, groups, x = block
        return {(p, g): _Ends(v.min(axis=0), v.max(axis=0)) for p, names in enumerate(groups) for g, v in _by_group(names, x).items()}

    seen = data.sum(ends)
    kept: dict[Fold, tuple[int, ...]] = {}
    train: dict[Fold, list] = {}
    for f in set(folds):
        train[f] = sorted((g for p, g in seen if p == f.part and g not in f.out), key=str)
        some = [seen[f.part, g] for g in train[f]]
        lo, hi = (np.min([e.lo for e in some], axis=0), np.max([e.hi for e in some], axis=0)) if some else (np.zeros(data.width), np.zeros(data.width))
        kept[f] = tuple(np.flatnonzero(lo != hi).tolist())
    moments = {}
    for columns in set(kept.values()):

        def products(block, columns=columns):
            _, _, groups, x = block
            x = np.hstack([scaled(x, columns), np.ones((len(x), 1))])
            return {(p, g): v.T @ v for p, names in enumerate(groups) for g, v in _by_group(names, x).items()}

        moments[columns] = data.sum(products)
    return {f: _space(kept[f], {g: moments[kept[f]][f.part, g] for g in train[f]}, data.balanced) for f in set(folds)}


def _space(kept: tuple[int, ...], moments: dict, balanced: bool) -> Space:
    counts = {g: float(m[-1, -1]) for g, m in moments.items()}
    n = sum(counts.values())
    weights = {g: n / (len(counts) * c) if balanced else 1.0 for g, c in counts.items()}
    whole = sum(moments.values()) / n
    mean = whole[-1, :-1]
    cov = whole[:-1, :-1] - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    inverse = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 1e-12)
    values, vectors = np.linalg.eigh(cov * np.outer(inverse, inverse))
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    k = max(1, min(len(kept), int(n) - 1))
    root = np.sqrt(values[:k])
    matrix = inverse[:, None] * vectors[:, :k] * np.divide(1.0, root, out=np.zeros_like(root), where=root > 1e-7)
    # Weighted second moments of the components and the constant, for the length of steps.
    weighted = sum(weights[g] * m for g, m in moments.items()) / n
    to = np.vstack([np.hstack([matrix, np.zeros((len(kept), 1))]), np.append(-mean @ matrix, 1.0)])
    return Space(kept, int(n), weights, mean, matrix, values[:k] / max(values.sum(), 1e-300), to.T @ weighted @ to)


def fit_all(data: Scans, space: dict[Fold, Space], wanted: list[tuple[Fold, int, float]], tolerance: float = 1e-8, most_scans: int = 1000) -> dict[tuple[Fold, int, float], Fit]:
    """A :class:`Fit` for each (fold, components, C): the least weighted mean of the logistic loss plus the sum of absolute
    coefficients over C times the rows.

    Accelerated proximal steps of the length that a fold's weighted second moments allow, started anew where they turn;
    every scan sums the gradients of all fits that still move by over *tolerance*. All start at zero: the components are
    scaled, so a few dozen steps do. Fits that have not come to rest after *most_scans* are an error."""
    state = {}
    for f, k, c in dict.fromkeys(wanted):
        s = space[f]
        at = [*range(k), s.gram.shape[0] - 1]
        largest = float(np.linalg.eigvalsh(s.gram[np.ix_(at, at)])[-1])
        state[f, k, c] = {"x": np.zeros(k + 1), "v": np.zeros(k + 1), "t": 1.0, "step": 4.0 / max(largest, 1e-12), "cut": 1.0 / (c * s.n)}
    open_ = list(state)
    while open_:
        if data.scans >= most_scans:
            raise ValueError(f"{len(open_)} fits have not come to rest after {most_scans} scans")
        grads = _gradients(data, space, [(key, state[key]["v"]) for key in open_])
        left = []
        for key, g in zip(open_, grads, strict=True):
            z = state[key]
            new = z["v"] - z["step"] * g
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - z["step"] * z["cut"], 0.0)
            move = new - z["x"]
            rest = np.abs(new - z["v"]).max()
            if float((z["v"] - new) @ move) > 0:
                z["t"] = 1.0  # the steps turn back: start anew
            t = (1 + (1 + 4 * z["t"] ** 2) ** 0.5) / 2
            z["v"] = new + (z["t"] - 1) / t * move
            z["x"], z["t"] = new, t
            if rest > tolerance:
                left.append(key)
        open_ = left
    return {key: Fit(*key, z["x"][:-1], float(z["x"][-1])) for key, z in state.items()}


def _gradients(data: Scans, space: dict[Fold, Space], points: list) -> list[np.ndarray]:
    """Gradients of the losses at the points ((fold, k, C), coefficients with the intercept last), from one scan."""
    by: dict = {}
    for i, ((f, k, c), v) in enumerate(points):
        by.setdefault((space[f].kept, f), []).append((i, Fit(f, k, c, v[:-1], float(v[-1]))))
    plan = []
    for (kept, f), some in by.items():
        lines = [fit.linear(space[f]) for _, fit in some]
        plan.append((kept, f.part, space[f].weights, np.array([u for u, _ in lines]).T, np.array([c for _, c in lines])))
    sent = data.blocks.context.broadcast(plan)

    def run(block):
        _, y, groups, x = block
        ready = {}
        out = {}
        for j, (kept, part, weights, u, c) in enumerate(sent.value):
            if kept not in ready:
                ready[kept] = scaled(x, kept)
            w = np.array([weights.get(g, 0.0) for g in groups[part]])
            r = (1 / (1 + np.exp(-np.clip(ready[kept] @ u + c, -500, 500))) - y[:, None]) * w[:, None]
            out[j] = np.vstack([ready[kept].T @ r, r.sum(axis=0)])
        return out

    sums = data.sum(run)
    sent.unpersist()
    grads: list = [None] * len(points)
    for j, ((_, f), some) in enumerate(by.items()):
        s = space[f]
        for col, (i, fit) in enumerate(some):
            g, total = sums[j][:-1, col], sums[j][-1, col]
            grads[i] = np.append((g - s.mean * total) @ s.matrix[:, : fit.k], total) / s.n
    return grads


def held_out_scores(data: Scans, space: dict[Fold, Space], asked: list[tuple[int, Fit, object]]) -> DataFrame:
    """(name, sample_id, y, score): each (name, fit, group) on the rows of that group, from one scan."""
    by: dict = {}
    for name, fit, held in asked:
        by.setdefault((fit.fold, held), []).append((name, *fit.linear(space[fit.fold])))
    plan = [(space[f].kept, f.part, held, [n for n, *_ in some], np.array([u for _, u, _ in some]).T, np.array([c for *_, c in some])) for (f, held), some in by.items()]
    sent = data.blocks.context.broadcast(plan)
    data.scans += 1

    def run(block):
        ids, y, groups, x = block
        for kept, part, held, labels, u, c in sent.value:
            rows = [i for i, g in enumerate(groups[part]) if g == held]
            if rows:
                p = 1 / (1 + np.exp(-np.clip(scaled(x[rows], kept) @ u + c, -500, 500)))
                for i, scores in zip(rows, p.tolist(), strict=True):
                    yield from ((label, ids[i], int(y[i]), s) for label, s in zip(labels, scores, strict=True))

    return data.spark.createDataFrame(data.blocks.flatMap(run), f"name int, sample_id {data.id_type}, y int, score double", verifySchema=False)


def stratified(rows: DataFrame, folds: int, seeds: list[int], key: str = "sample_id", y: str = "y") -> DataFrame:
    """Adds fold0, fold1 and so on, for each of *seeds* a fold from 0 to *folds* - 1, dealt in turn within each class in the
    order of a hash: the folds' numbers of a class differ by one at most.

    A row's rank is its rank among its class's rows in one of 256 ranges of the hash plus the rows of the ranges before, so
    no task holds a class. Rows that repeat a key follow each other in any order."""
    rows = stage_table(rows.withColumn("__row", F.monotonically_increasing_id()), "dealt")
    long = rows.select("__row", F.col(key).alias("k"), F.col(y).alias("y"), F.posexplode(F.array(*map(F.lit, seeds))).alias("i", "seed"))
    long = long.withColumn("h", F.xxhash64("seed", "k")).withColumn("b", F.shiftright("h", 56))
    counts = long.groupBy("i", "y", "b").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("i", "y").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("i").alias("ci"), F.col("y").alias("cy"), F.col("b").alias("cb"), F.coalesce(before, F.lit(0)).alias("before"))
    long = long.join(F.broadcast(counts), (F.col("i") == F.col("ci")) & F.col("y").eqNullSafe(F.col("cy")) & (F.col("b") == F.col("cb")))
    rank = F.row_number().over(Window.partitionBy("i", "y", "b").orderBy("h", "k")) - 1 + F.col("before")
    dealt = long.select("__row", "i", (rank % folds).cast("int").alias("fold")).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("i", "fold"))).alias("__dealt"))
    rows = rows.join(dealt, "__row")
    return rows.select(*[c for c in rows.columns if c not in ("__row", "__dealt")], *[F.col("__dealt")[i]["fold"].alias(f"fold{i}") for i in range(len(seeds))])
