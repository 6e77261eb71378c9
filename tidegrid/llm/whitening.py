"""Embedding whitening: a distributed centred scatter, cyclic Jacobi in the driver, a broadcast matrix.

An entry c becomes the whole number ``x = floor(1024 c) + 100000``. Tasks sum x by
dimension; a second pass centres each vector at the nearest whole numbers to the
means and sums its products with itself. These are whole numbers too, exact in doubles below
2**53, so the sums do not depend on the order of tasks; what the means are beyond whole
numbers (half a unit at most) is corrected afterwards. Only sums travel, a row of the
matrix from each task, and Spark adds them up; the driver gets the d x d matrix of the covariance, a size
that does not grow with the rows.

There symmetric rotations go around all pairs of dimensions until each off-diagonal
entry is negligible beside the two diagonal ones it lies between, which keeps small eigenvalues
accurate to their own size. Eigenvectors are sorted by falling eigenvalue, with their
largest entry positive, divided by the root of the eigenvalue and broadcast.

Cases: dropped are null vectors and those with null or non-finite entries, entries of
2**30 or more (which have no 41-bit x), and those of another length than most
(of lengths equally frequent the longest counts); repeated rows count each, rows of equal id keep
their own results; components without variance have no whitened values and no rows, so one vector or equal ones
give none; a deviation beyond 64 bits is null; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: x = floor(SCALE c) + SHIFT.
SCALE, SHIFT = 1024, 100000
#: Entries of this size or more are dropped with the non-finite ones.
LIMIT = float(1 << 30)


def vectors(batch: pa.RecordBatch, only: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x) of the good vectors of a batch, by length."""
    column = batch.column("vector")
    at = np.asarray(column.offsets)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is not a number there
    good = ~np.asarray(column.is_null())
    size = np.where(good, np.diff(at), -1)
    for d in [only] if only is not None else np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        c = flat[at[rows][:, None] + np.arange(d)]
        fine = (np.abs(c) < LIMIT).all(1)
        yield d, rows[fine], np.floor(SCALE * c[fine]).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, i, n, s): of each length and dimension the number of vectors and the sum of x."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for d, rows, x in vectors(batch):
            n, s = held.get(d, (0, np.zeros(d, np.int64)))
            held[d] = (n + len(rows), s + x.sum(0))
    for d, (n, s) in held.items():
        yield pa.record_batch([np.full(d, d, np.int32), np.arange(d, dtype=np.int32), np.full(d, n), s], names=["d", "i", "n", "s"])


def _scatter(near: np.ndarray, matrix: np.ndarray | None = None, rest: np.ndarray | None = None):
    """(i, row): the sums of products of vectors less ``near``, or of what ``matrix`` makes of them; the last row has the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(near) if matrix is None else matrix.shape[1]
        out = np.zeros((k + 1, k))
        for batch in batches:
            for _, _, x in vectors(batch, len(near)):
                y = (x - near).astype(float)
                if matrix is not None:
                    y = (y - rest) @ matrix
                out[:k] += y.T @ y
                out[k] += y.sum(0)
        yield pa.record_batch([np.arange(k + 1, dtype=np.int32), pa.array(list(out), pa.list_(pa.float64()))], names=["i", "row"])

    return run


def _added(rows: DataFrame, k: int) -> np.ndarray:
    """The tasks' matrices summed by Spark, place by place."""
    places = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((k + 1, k))
    out[places.column("i").to_numpy(), places.column("j").to_numpy()] = places.column("v").to_numpy()
    return out


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, the largest entry of each positive) of a symmetric matrix.

    Rotations go around all pairs by rows; a sweep without one ends it. An entry is
    negligible from 2**-53 of the geometric mean of its diagonal entries on, or where rounding alone explains it.
    """
    a = np.array(a, float)
    d = len(a)
    v = np.eye(d)
    dust = 2.0**-53 * 2.0**-53 * max(float(np.abs(a).max(initial=0)), 2.0**-900)
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off, one, two = float(a[p, q]), float(a[p, p]), float(a[q, q])
                if abs(off) <= dust or abs(off) <= 2.0**-53 * (abs(one) * abs(two)) ** 0.5:
                    continue
                turned = True
                # The smaller root of t**2 + 2 t theta - 1 = 0 turns by 45 degrees at most.
                theta = (two - one) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + (1 + theta * theta) ** 0.5) if abs(theta) < 1e150 else 0.5 / theta
                c = 1 / (1 + t * t) ** 0.5
                s = t * c
                for x, y in ((a[:, p], a[:, q]), (a[p], a[q]), (v[:, p], v[:, q])):
                    was = x.copy()
                    x *= c
                    x -= s * y
                    y *= c
                    y += s * was
                a[p, p], a[q, q] = one - t * off, two + t * off
                a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    if d:
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return np.diag(a)[order], v


@dataclass
class Fit:
    """n vectors, sums of x by dimension, eigenvalues of their covariance with eigenvectors, and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def near(self) -> np.ndarray:
        """The whole numbers nearest to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the means are beyond ``near``."""
        return np.array([(s - self.n * q) / self.n for s, q in zip(self.sums, self.near.tolist(), strict=True)])

    def whitening(self, components: int) -> np.ndarray:
        """The projection onto the first components that have variance, over its root."""
        k = int((self.values > len(self.sums) * 2.0**-52 * max(self.values.max(initial=0), 0)).sum())
        k = min(k, components)
        return self.vectors[:, :k] / np.sqrt(self.values[:k])


def fit(rows: DataFrame) -> Fit | None:
    """Sums, covariance and its eigenvectors of ``rows(id, vector)``; None without a vector."""
    told = rows.mapInArrow(_sums, "d int, i int, n long, s long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    told = written(told, "sums", free=False)
    top = told.where("i = 0 AND n > 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").first()
    if top is None:
        return None
    sums = [int(x.s) for x in told.where(F.col("d") == top.d).orderBy("i").collect()]  # a row a dimension
    out = Fit(top.n, sums, np.zeros(top.d), np.eye(top.d), 0.0)
    products = _added(rows.mapInArrow(_scatter(out.near), "i int, row array<double>"), top.d)[: top.d]
    covariance = products / top.n - np.outer(out.rest, out.rest)
    out.values, out.vectors = jacobi(covariance)
    out.trace = float(np.trace(covariance))
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int], near: np.ndarray) -> pa.Array:
    """Sums of (n x - S)**2 in whole numbers; null beyond 64 bits."""
    rest = [s - n * q for s, q in zip(sums, near.tolist(), strict=True)]
    y = x - near
    small = (n * np.abs(y).astype(float) + n) ** 2
    safe = (small.sum(1) < 2.0**62) & (n < 1 << 62)
    out: list[int | None] = [None] * len(x)
    fine = np.flatnonzero(safe)
    diff = n * y[fine] - np.array(rest, np.int64) if len(fine) else y[fine]
    for k, v in zip(fine.tolist(), (diff * diff).sum(1).tolist(), strict=True):
        out[k] = v
    for k in np.flatnonzero(~safe).tolist():
        v = sum((n * a - r) ** 2 for a, r in zip(y[k].tolist(), rest, strict=True))
        out[k] = v if v < 1 << 63 else None
    return pa.array(out, pa.int64())


def _projected(model: Fit, matrix: np.ndarray, error: float):
    k = matrix.shape[1]
    explained = model.values[:k] / model.trace if k else np.zeros(0)
    n, sums, near, rest = model.n, model.sums, model.near, model.rest  # all that is sent, beside d x k of the matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, x in vectors(batch, len(near)):
                white = ((x - near).astype(float) - rest) @ matrix
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.record_batch(
                    [batch.column("id").take(pa.array(rows)).take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)), np.full(len(each), n), _deviations(x, n, sums, near).take(each), white.ravel(), np.tile(explained, len(rows)), np.full(len(each), error)],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(row_id, component, n, deviation, whitened, explained, identity_error): a row for each good vector and component.

    ``explained`` is the component's share of all variance; ``identity_error`` the largest
    entry of the whitened values' covariance, measured over all rows, less the identity.
    """
    rows = df.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    schema = f"id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows)
    if model is None:
        out = df.sparkSession.createDataFrame([], schema)
    else:
        matrix = model.whitening(components)
        k = matrix.shape[1]
        error = 0.0
        if k:
            measured = _added(rows.mapInArrow(_scatter(model.near, matrix, model.rest), "i int, row array<double>"), k) / model.n
            error = float(np.abs(measured[:k] - np.outer(measured[k], measured[k]) - np.eye(k)).max())
        out = rows.mapInArrow(_projected(model, matrix, error), schema)
    return out.withColumnRenamed("id", row_id)
