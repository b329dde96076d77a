"""Whitening of embeddings: exact sums, a centred scatter, cyclic Jacobi rotations on the driver.

Entries become integers first (``floor(scale * c) + shift``), so numbers of rows and sums are exact whatever the
order of tasks. A second pass adds up the products of centred entries; only the upper triangle of that matrix, whose
size is the dimension squared and never grows with rows, comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOP = 1 << 52  # entries saturate here, where doubles still hold every integer
_LONG = 1 << 62


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix.

    Sweeps go through all pairs in turn; a pair is rotated unless its entry is below the rounding error of
    its own two diagonal entries, and the sweeps end when none is. Small eigenvalues thus keep the relative
    accuracy that the matrix itself gives them.
    """
    a, n = np.array(a, float), len(a)
    v = np.eye(n)
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                off = a[p, q]
                if off == 0.0 or abs(off) <= eps * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                half = (a[q, q] - a[p, p]) / (2.0 * off)
                t = (1.0 if half >= 0 else -1.0) / (abs(half) + np.hypot(1.0, half))
                c = 1.0 / np.hypot(1.0, t)
                s = t * c
                app, aqq = a[p, p] - t * off, a[q, q] + t * off
                row_p, row_q = a[p].copy(), a[q].copy()
                a[p] = a[:, p] = c * row_p - s * row_q
                a[q] = a[:, q] = s * row_p + c * row_q
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                col_p = v[:, p].copy()
                v[:, p] = c * col_p - s * v[:, q]
                v[:, q] = s * col_p + c * v[:, q]
        if not turned:
            break
    e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


@dataclass
class Whitening:
    """The fit: number of rows, exact sums, all eigenvalues and, as columns, the components kept."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    scale: float
    shift: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values[: self.vectors.shape[1]])


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows whose vector is there, has entries, and none of them null, NaN or infinite."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.select(F.col(id_col).alias("id"), v.alias("v")).filter((F.size("v") > 0) & ~bad)


def integers(column: pa.Array, dim: int, scale: float, shift: int) -> np.ndarray:
    """The (rows, dim) matrix of long entries of a batch of vectors."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(scale * values), -_TOP, _TOP).astype(np.int64) + shift


def _batches(batches, column: int, dim: int, scale: float, shift: int, most: int = 1 << 22):
    """(batch, integers) in pieces of at most *most* entries."""
    step = max(1, most // dim)
    for whole in batches:
        for i in range(0, whole.num_rows, step):
            b = whole.slice(i, step)
            yield b, integers(b.column(column), dim, scale, shift)


def _scatter(vectors: DataFrame, k: int, rows_of) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products, and sums, of the *k* columns that *rows_of* makes of each batch. Every task passes its own
    upper triangle on; Spark adds them up."""
    p, q = np.triu_indices(k)

    def run(batches):
        total, first = np.zeros((k, k)), np.zeros(k)
        for w in rows_of(batches):
            total += w.T @ w
            first += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*p, *range(k)], pa.int32()), pa.array([*q, *[-1] * k], pa.int32()), pa.array(np.concatenate([total[p, q], first]))], ["p", "q", "s"]
        )

    out, sums = np.zeros((k, k)), np.zeros(k)
    for r in vectors.select("v").mapInArrow(run, "p int, q int, s double").groupBy("p", "q").agg(F.sum("s").alias("s")).collect():
        if r["q"] < 0:
            sums[r["p"]] = r["s"]
        else:
            out[r["p"], r["q"]] = out[r["q"], r["p"]] = r["s"]
    return out, sums


def fit(vectors: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000, max_dim: int = 1024) -> Whitening | None:
    """The whitening of all rows of *vectors* (id, v), see :func:`usable`; None where there are none.

    All vectors must be of one length, at most *max_dim* (the rotations take the cube of it on the driver), else it
    is an error. Components whose eigenvalue is zero within rounding are left out: nothing varies along them, so
    they can't be brought to variance one. Repeated rows count each.
    """
    spans = vectors.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if spans["lo"] is None:
        return None
    dim = spans["hi"]
    if spans["lo"] != dim or dim > max_dim:
        raise ValueError(f"vectors have {spans['lo']} to {dim} entries; one length of at most {max_dim} is expected")

    def add(batches):
        n, sums = 0, [0] * dim
        for _, x in _batches(batches, 0, dim, scale, shift):
            # Halves of 26 bits add up without overflow for 2^36 rows of a batch.
            lo, hi = (x & ((1 << 26) - 1)).sum(axis=0), (x >> 26).sum(axis=0)
            sums = [s + int(a) + (int(b) << 26) for s, a, b in zip(sums, lo, hi, strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(s) for s in sums]), pa.array([n] * dim, pa.int64())], ["d", "s", "n"])

    rows = vectors.select("v").mapInArrow(add, "d int, s string, n long").groupBy("d").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s"), F.sum("n").alias("n")).collect()
    sums, n = [0] * dim, rows[0]["n"]
    for r in rows:
        sums[r["d"]] = int(r["s"])
    model = Whitening(n, sums, np.ones(dim), np.eye(dim), scale, shift)
    mean = model.mean
    total, _ = _scatter(vectors, dim, lambda bs: (x - mean for _, x in _batches(bs, 0, dim, scale, shift)))
    values, vectors_ = jacobi(total / n)
    kept = min(components, int((values > dim * np.finfo(float).eps * max(values[0], 0.0)).sum()))
    return Whitening(n, sums, np.maximum(values, 0.0), vectors_[:, :kept], scale, shift)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k, dim = model.vectors.shape[1], len(model.sums)
    if not k:
        return 0.0
    total, sums = _scatter(vectors, k, lambda bs: (model.project(x) for _, x in _batches(bs, 0, dim, model.scale, model.shift)))
    centre = sums / model.n
    return float(np.abs(total / model.n - np.outer(centre, centre) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
    base = [s // n for s in sums]
    near = x - np.array(base, np.int64)
    rest = [s - n * b for s, b in zip(sums, base, strict=True)]  # 0 to n - 1
    if len(x) and n * (int(np.abs(near).max()) + 1) < int((_LONG / max(1, len(sums))) ** 0.5):
        return (((n * near - np.array(rest, np.int64)) ** 2).sum(axis=1)).tolist()
    exact = (sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near.tolist())
    return [d if d < 1 << 63 else None for d in exact]


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """Per usable row of *table*: vec_id, deviation, and whitened, its coordinates along the components (array);
    beside them n, values (of the components, falling), explained (array) and identity_error, the same for all rows.

    Rows whose vector is null, empty or holds null, NaN or infinite entries are dropped; repeated rows stay each,
    and a null id is kept. A deviation beyond a long is null. Entries beyond 2^52 after scaling count as that bound.
    Other columns of *table* may have any name; none is read. An empty table gives no rows.
    """
    vectors = usable(table, id_col, vector_col)
    kind = table.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    model = fit(vectors, components, scale, shift)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    error, dim, k = identity_error(vectors, model), len(model.sums), model.vectors.shape[1]
    share = (model.values[:k] / model.values.sum()).tolist() if k else []
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b, x in _batches(batches, 1, dim, m.scale, m.shift, 1 << 20):
            w = m.project(x)
            rows = pa.ListArray.from_arrays(pa.array(range(0, k * len(x) + 1, k) if k else [0] * (len(x) + 1), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations(x, m.n, m.sums), pa.int64()), rows], ["vec_id", "deviation", "whitened"])

    out = vectors.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")
    shares = F.array(*[F.lit(e) for e in share]).cast("array<double>")
    return out.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))


def by_component(rows: DataFrame) -> DataFrame:
    """A row for each row of :func:`whiten` and component, numbered from 1."""
    long = rows.select("*", F.posexplode("whitened").alias("at", "w"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("w").alias("whitened"), F.get("explained", F.col("at")).alias("explained"), "identity_error")
