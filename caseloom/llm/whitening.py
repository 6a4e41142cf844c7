"""Whitening of vectors by the leading eigenvectors of their covariance.

1. Entries become whole numbers, ``floor(SCALE * c) + SHIFT``.  Count and exact sums per dimension are
   a small aggregation.
2. Each task adds up products of centred vectors; the sums of the tasks are added per pair of
   dimensions in a shuffle.  What the driver gets has the square of the dimension, not of the rows.
3. On the driver the covariance is made tridiagonal by Householder reflections.  Sturm counts give
   the leading eigenvalues by bisection; inverse iteration gives their vectors, made orthogonal
   inside clusters of close eigenvalues, and the reflections carry them back.
4. The components are broadcast and each row is projected in its task.  The covariance of the
   projections, in another small aggregation, tells how far they are from the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
# Entries are whole numbers below this size, so that products with the count of rows stay exact.
LARGEST = 1 << 31
# Eigenvalues below this part of the trace are rounding, not spread.
NOISE = 1e-12
STEP = 4_096  # rows that one numpy step takes


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflections (one per row, unit or zero) of a symmetric matrix."""
    a = np.array(a, float)
    d = len(a)
    reflections = np.zeros((max(0, d - 2), d))
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        if size == 0 or not np.abs(x[1:]).max():
            continue
        x /= size
        x[0] += np.copysign(np.sqrt(x @ x), x[0])
        v = x / np.sqrt(x @ x)
        reflections[k, k + 1 :] = v
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (p @ v) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each of ``at``: the negative pivots of T - at."""
    square = np.r_[0.0, off**2]
    tiny = np.finfo(float).tiny * max(1.0, square.max()) + np.finfo(float).tiny
    count, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for x, b in zip(diagonal, square, strict=True):
        q = x - at - (b / q if b else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring numbers."""
    d = len(diagonal)
    around = np.r_[np.abs(off), 0.0] + np.r_[0.0, np.abs(off)]
    span = np.abs(diagonal).max() + around.max()
    low = np.full(k, (diagonal - around).min() - 1e-15 * span)
    high = np.full(k, (diagonal + around).max() + 1e-15 * span)
    rank = d - np.arange(k)  # eigenvalues up to and including the wanted one, from below
    for _ in range(1200):
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            break
        above = sturm_count(diagonal, off, middle) >= rank
        high = np.where(open_ & above, middle, high)
        low = np.where(open_ & ~above, middle, low)
    return high


def _solve(diagonal: np.ndarray, off: np.ndarray, at: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - at) x = right by elimination with exchange of neighbouring rows."""
    d = len(diagonal)
    u0, u1, u2 = diagonal - at, np.r_[off, 0.0], np.zeros(d)
    x = right.copy()
    for i in range(d - 1):
        if abs(off[i]) > abs(u0[i]):
            factor = u0[i] / off[i]
            u0[i], u0[i + 1], first = off[i], u1[i] - factor * u0[i + 1], u0[i + 1]
            second = u1[i + 1]
            u1[i], u1[i + 1], u2[i] = first, -factor * second, second
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if abs(u0[i]) < least:
                u0[i] = np.copysign(least, u0[i])
            factor = off[i] / u0[i]
            u0[i + 1] -= factor * u1[i]
            x[i + 1] -= factor * x[i]
    for i in range(d - 1, -1, -1):
        if abs(u0[i]) < least:
            u0[i] = np.copysign(least, u0[i])
        rest = x[i]
        if i + 1 < d:
            rest -= u1[i] * x[i + 1]
        if i + 2 < d:
            rest -= u2[i] * x[i + 2]
        x[i] = rest / u0[i]
        if abs(x[i]) > 1e150:
            x *= 1e-150
    return x


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of a tridiagonal matrix, one per row, by inverse iteration.  A vector is kept
    orthogonal to those of eigenvalues that are close in a chain to its own."""
    d, span = len(diagonal), float(np.abs(diagonal).max() + 2 * (np.abs(off).max() if len(off) else 0.0))
    if span == 0:
        return np.eye(d)[: len(values)]
    rng, eps = np.random.default_rng(12), np.finfo(float).eps
    out, cluster, shift = np.zeros((len(values), d)), 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * span:
            cluster = k
        # Equal eigenvalues are moved apart by a rounding step, falling like the values.
        shift = value if k == cluster else min(value, shift - 4 * eps * span)
        x = rng.standard_normal(d)
        for _ in range(5):
            for _ in range(2):
                x -= out[cluster:k].T @ (out[cluster:k] @ x)
            x = _solve(diagonal, off, shift, x / np.sqrt(x @ x), eps * span)
        for _ in range(2):
            x /= np.abs(x).max()
            x -= out[cluster:k].T @ (out[cluster:k] @ x)
        out[k] = x / np.sqrt(x @ x)
    return out


def leading(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, and their unit vectors as rows."""
    diagonal, off, reflections = tridiagonal(covariance)
    values = leading_eigenvalues(diagonal, off, min(k, len(diagonal)))
    vectors = eigenvectors(diagonal, off, values)
    for v in reflections[::-1]:
        vectors -= 2 * np.outer(vectors @ v, v)
    return values, vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


@dataclass
class Model:
    """What a fit keeps: count, sums per dimension, eigenvalues, components as rows, trace, and how far
    the covariance of the whitened fit rows is from the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of whole-number vectors."""
        whole, rest = np.divmod(self.sums, self.n)
        return ((x - whole) - rest / self.n) @ self.components.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2 of each row, exact; none if no long can hold it."""
        apart = self.n * x - self.sums
        high, low = np.divmod(np.abs(apart), 1 << 24)
        if len(x) and high.max() >= 1 << 24:
            exact = [sum(v * v for v in row) for row in apart.tolist()]
        else:  # parts of 24 bits: their products and the sums of these fit
            parts = (high * high).sum(axis=1), (2 * high * low).sum(axis=1), (low * low).sum(axis=1)
            exact = [(a << 48) + (b << 24) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
        return [v if v < 1 << 63 else None for v in exact]


def _length(vectors: DataFrame, col: str) -> int:
    """The length that most usable vectors have, of equally frequent ones the larger; 0 if there is none."""
    rows = vectors.where(_usable(F.col(col))).groupBy(F.size(col).alias("d")).count()
    most = rows.orderBy(F.desc("count"), F.desc("d")).first()
    return most["d"] if most else 0


def _usable(vector: Column) -> Column:
    size = (LARGEST - SHIFT) / SCALE
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= size))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _matrices(batch: pa.RecordBatch, at: int, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and whole-number vectors of each step of a batch."""
    for low in range(0, batch.num_rows, STEP):
        own = batch.column(at).slice(low, STEP)
        values = own.flatten().to_numpy(zero_copy_only=False).astype(float)
        yield low, np.floor(SCALE * values).astype(np.int64).reshape(-1, d) + SHIFT


def _summed(rows: DataFrame, at: int, d: int, work: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all rows of the numbers that ``work`` gives for a step of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _matrices(batch, at, d):
                own = work(x)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])

    parts = rows.mapInArrow(each, f"place long, value {kind}")
    found = parts.groupBy("place").agg(F.sum("value").alias("value")).toArrow().sort_by("place")
    return found["value"].to_numpy()


def fit(vectors: DataFrame, col: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """Model of all usable rows; none if there is no such row or they do not differ.

    Components whose eigenvalue is rounding (below ``NOISE`` of the trace) are left out.
    """
    d = _length(vectors, col)
    if not d:
        return None
    rows = _fitting(vectors, col, d).select(col)
    first = _summed(rows, 0, d, lambda x: np.r_[len(x), x.sum(axis=0)], "long")
    n, sums = int(first[0]), first[1:]
    whole, rest = np.divmod(sums, n)

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - whole) - rest / n
        return (y.T @ y).ravel()

    covariance = _summed(rows, 0, d, products, "double").reshape(d, d) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    if not trace > 0:
        return None
    values, found = leading(covariance, components)
    real = values > NOISE * trace
    model = Model(n, sums, values[real], found[real], trace)
    k = len(model.values)

    def spread(x: np.ndarray) -> np.ndarray:
        y = model.project(x)
        return np.r_[y.sum(axis=0), (y.T @ y).ravel()]

    total = _summed(rows, 0, d, spread, "double") / n
    mean, second = total[:k], total[k:].reshape(k, k)
    model.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return model


def _fitting(vectors: DataFrame, col: str, d: int) -> DataFrame:
    return vectors.where(_usable(F.col(col)) & (F.size(col) == d))


def whiten(vectors: DataFrame, model: Model | None, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` of each usable row and
    each component of ``model``.

    Null vectors, those with a null or non-finite entry, empty ones, entries of 2 million or more and
    lengths other than the model's give no row; nor does any row if there is no model.  Null and
    repeated ids are kept.  Equal eigenvalues get any orthogonal pair of components, the same for all
    rows.  A deviation that no long can hold is null.  Other columns are ignored.
    """
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [vectors.schema[id_col].dataType, T.IntegerType(), T.LongType(), T.LongType(), *[T.DoubleType()] * 3]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, k = model.components.shape[1], len(model.values)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for low, x in _matrices(batch, 1, d):
                size = len(x)
                place = pa.array(np.repeat(np.arange(low, low + size), k))
                deviation = pa.array(own.deviations(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(place),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * k, own.n)),
                        deviation.take(pa.array(np.repeat(np.arange(size), k))),
                        pa.array(own.project(x).ravel()),
                        pa.array(np.tile(own.values / own.trace, size)),
                        pa.array(np.full(size * k, own.identity_error)),
                    ],
                    names=names,
                )

    return _fitting(vectors, col, d).select(id_col, col).mapInArrow(work, schema)
