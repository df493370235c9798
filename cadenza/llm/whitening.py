"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Every entry c of a vector becomes the integer ``floor(64 c) + 1000000``.
The distinct integer vectors are the fit list X, centred by their mean. The
iteration alternates the products ``X v`` and ``Xᵀ u``, both distributed
over blocks of rows:

* ``t = X v - beta u'`` is made orthogonal to all earlier left vectors u,
  its length is the next diagonal entry alpha;
* ``Xᵀ u - alpha v`` is made orthogonal to all earlier right vectors v, its
  length is the next entry beta beside the diagonal.

A left vector has an entry for every row, so none is ever stored: each is
``X w`` for a short vector w, which the driver keeps, and a task makes the
entries of its rows anew. The dot products with earlier left vectors, which
the orthogonalisation needs, come with the same pass. A pass sums per task,
then by entry; the driver sees one vector's length of numbers.

The singular values and right vectors of the small bidiagonal matrix give
the components and their deviations. The iteration ends when the wanted
ones have converged, or after as many steps as there are dimensions. A
direction that ends early (equal eigenvalues, no variance) is followed by a
new one, orthogonal to all before, so that no component is missed.

Defined results: rows whose vector is null or holds null or non-finite
entries are dropped; vectors of each length are a fit of their own; an
empty vector has no components; components without variance (fewer distinct
vectors than dimensions, constant entries) are not returned, so one single
distinct vector gives no rows; repeated rows and ids return once each; an
entry too large for 64-bit arithmetic is an error; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import scratch_table

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Bytes of a block of rows.
BLOCK_BYTES = 1 << 20
#: Residual, and smallest deviation, as a share of the largest deviation.
CONVERGED, NOTHING = 1e-14, 1e-9
SEED = 13


def usable(vector: str) -> Column:
    """Vectors without null or non-finite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(vector: str) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("bigint"))


def _matrix(col: pa.Array, size: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, size).astype(np.int64, copy=False)


def blocks(x: DataFrame, size: int) -> DataFrame:
    """The distinct vectors ``x`` (array of bigint) packed as ``block``."""
    rows = max(1, BLOCK_BYTES // (8 * size))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            m = _matrix(batch.column(0), size)
            packed = [m[i:i + rows].tobytes() for i in range(0, len(m), rows)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["block"])

    return scratch_table(x.distinct().mapInArrow(run, "block binary"))


def _unpacked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for raw in batch.column(0):
            yield np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, size)


def summed(rows: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray], kind: str, length: int) -> np.ndarray:
    """The sum of the vector ``of(block)`` over all blocks: per task, then
    by entry."""
    def run(batches):
        total = None
        for m in _unpacked(batches, size):
            total = of(m) if total is None else total + of(m)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length), pa.int64()), pa.array(total)], ["i", "v"])

    found = rows.mapInArrow(run, f"i bigint, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = [0] * length
    for r in found:
        out[r["i"]] = r["v"]
    return np.array(out, np.int64 if kind == "bigint" else np.float64)


@dataclass
class Fit:
    """Rows, exact sums per dimension, and the components with the
    eigenvalues of their covariance, largest first."""
    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, m: np.ndarray) -> np.ndarray:
        return _centred(m, self.n, self.sums)

    def whitened(self, m: np.ndarray) -> np.ndarray:
        return self.centred(m) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def _deviations(m: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S``, exactly."""
    if max(int(np.abs(m).max(initial=0)), 1) * n >= 1 << 62:
        raise OverflowError("n times an entry does not fit 64 bits")
    return m * n - sums


def _centred(m: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _deviations(m, n, sums) / n


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Fit | None:
    """The first components of the centred ``rows`` (blocks of vectors of
    ``size`` entries); None without variance."""
    counted = summed(rows, size, lambda m: np.r_[len(m), _column_sums(m)], "bigint", size + 1)
    n, sums = int(counted[0]), counted[1:]
    if n < 2:
        return None
    trace = summed(rows, size, lambda m: np.array([(_centred(m, n, sums) ** 2).sum()]), "double", 1)[0] / n
    if trace <= 0:
        return None

    rng = np.random.default_rng(SEED)
    floor = NOTHING * np.sqrt(n * trace)
    v = _direction(rng, np.zeros((0, size)), size)
    right, left = np.zeros((0, size)), np.zeros((0, size))   # v's, and w's with u = X w
    back = np.zeros((0, size))                               # Xᵀ u
    diagonal: list[float] = []
    beside: list[float] = [0.0]                              # beside[j] joins u_(j-1) and v_j
    while True:
        w = v - beside[-1] * left[-1] if len(left) else v
        y, g, length = _products(rows, size, n, sums, w, left)
        # orthogonal to all earlier left vectors
        w, y = w - g @ left, y - g @ back
        alpha = float(np.sqrt(max(length - g @ g, 0.0)))
        right = np.vstack([right, v])
        if alpha <= floor:                                   # no variance along v
            alpha, w, y = 0.0, np.zeros(size), np.zeros(size)
        else:
            w, y = w / alpha, y / alpha
        left, back = np.vstack([left, w]), np.vstack([back, y])
        diagonal.append(alpha)
        if len(right) == size:
            break
        v = y - alpha * right[-1]
        for _ in range(2):
            v = v - (v @ right.T) @ right
        beta = float(np.linalg.norm(v))
        if beta <= floor:                                    # nothing left to reach from here
            beta, v = 0.0, _direction(rng, right, size)
            beside.append(beta)
            continue
        v = v / beta
        beside.append(beta)
        if _converged(diagonal, beside, components):
            break
    p, s, q = np.linalg.svd(np.diag(diagonal) + np.diag(beside[1:len(diagonal)], 1))
    kept = int((s > floor).sum())
    kept = min(kept, components)
    if not kept:
        return None
    found = Fit(n, sums, q[:kept] @ right, s[:kept] ** 2 / n, float(trace))
    found.identity_error = _identity_error(rows, size, found)
    return found


def _column_sums(m: np.ndarray) -> np.ndarray:
    if int(np.abs(m).max(initial=0)) * max(len(m), 1) >= 1 << 62:
        raise OverflowError("an entry is too large for exact sums")
    return m.sum(0)


def _products(rows: DataFrame, size: int, n: int, sums: np.ndarray, w: np.ndarray, left: np.ndarray):
    """``Xᵀ t``, the dot products of ``t`` with all left vectors, and ``t``'s
    square, for ``t = X w``."""
    k = len(left)

    def of(m):
        x = _centred(m, n, sums)
        t = x @ w
        return np.r_[x.T @ t, (x @ left.T).T @ t, t @ t]

    out = summed(rows, size, of, "double", size + k + 1)
    return out[:size], out[size:size + k], out[-1]


def _direction(rng: np.random.Generator, right: np.ndarray, size: int) -> np.ndarray:
    """A unit vector orthogonal to the rows of ``right``."""
    v = rng.standard_normal(size)
    for _ in range(3):
        v = v - (v @ right.T) @ right
        v = v / np.linalg.norm(v)
    return v


def _converged(diagonal: list[float], beside: list[float], components: int) -> bool:
    """Whether the first components' residuals, and the gap behind them, are
    settled: each is the new entry beside the diagonal times the last entry
    of a left singular vector."""
    k = len(diagonal)
    if k < 2 * components:
        return False
    p, s, _ = np.linalg.svd(np.diag(diagonal) + np.diag(beside[1:k], 1))
    return bool((beside[k] * np.abs(p[-1, :components]) <= CONVERGED * s[0]).all())


def _identity_error(rows: DataFrame, size: int, found: Fit) -> float:
    k = len(found.values)

    def of(m):
        z = found.whitened(m)
        return np.r_[(z.T @ z).ravel(), z.sum(0)]

    out = summed(rows, size, of, "double", k * k + k) / found.n
    second, mean = out[:k * k].reshape(k, k), out[k * k:]
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def _rows(x: DataFrame, size: int, found: Fit, id_col: str) -> DataFrame:
    kind = x.schema[id_col].dataType.simpleString()
    k = len(found.values)
    explained = found.values / found.trace

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                m = _matrix(part.column(1), size)
                n = len(m)
                d = _deviations(m, found.n, found.sums)
                if int(np.abs(d).max(initial=0)) ** 2 * size >= 1 << 63:  # in Python's integers
                    d = d.astype(object)
                deviation = (d * d).sum(1).tolist()
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, found.n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(found.whitened(m).ravel()), pa.array(np.tile(explained, n)),
                    pa.array(np.full(n * k, found.identity_error))], names)

    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return x.select(id_col, "x").mapInArrow(
        run, f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
             "identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """For every usable row and each of at most ``components`` components:
    ``id, component, n`` (distinct vectors), ``deviation`` (the sum of
    ``(n x - S)^2``), ``whitened``, ``explained`` and ``identity_error``."""
    spark = vectors.sparkSession
    x = vectors.select(F.col(id_col), F.col(f"`{vector_col}`").alias("v")).filter(usable("v")) \
        .select(id_col, integers("v").alias("x"))
    out = None
    for size in sorted(r["n"] for r in x.select(F.size("x").alias("n")).distinct().collect()):
        own = x.filter(F.size("x") == size)
        found = fit(blocks(own.select("x"), size), size, components) if size else None
        if found is not None:
            part = _rows(own, size, found, id_col)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else _no_rows(spark, x, id_col)


def _no_rows(spark: SparkSession, x: DataFrame, id_col: str) -> DataFrame:
    kind = x.schema[id_col].dataType.simpleString()
    return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n bigint, deviation bigint, "
                                     "whitened double, explained double, identity_error double")
