"""Embedding whitening by LOBPCG over distributed covariance products.

Entries become integers floor(scale * c) + shift. Their number and sums are
exact, so a row's distance from the mean is an exact integer over n, and every
product is made of centred rows. The leading eigenvectors of the covariance V
come from locally optimal block preconditioned conjugate gradients (without a
preconditioner):

* a block product V B is one Spark job: each task multiplies its centred rows
  with B and their transpose with that, and Spark sums the tasks' cells;
* the trial space is the iterate X, its residuals R = V X - X E and the previous
  directions P, made orthonormal, with directions left out that add nothing;
* Rayleigh-Ritz on that space gives the next X and P;
* once the residuals look small enough, V X is made anew from the data, and the
  iteration ends only when those residuals are, too.

The driver holds blocks of as many rows as a vector has entries, whatever the
table's size. A last job gives the covariance of the whitened rows.

Null vectors and vectors with null or non-finite entries take no part, nor do
vectors shorter than the longest; rows that repeat count as often as they are
there. Directions without variance are no components: constant columns, a single
row or copies of one vector give fewer components, or none, and an empty table
no rows. Entries of 2**52 or more after scaling raise an error, and a deviation
beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.vectors import matrix, taking_part
from vigil.session import ship_package

#: Residuals of the components, as a share of the largest eigenvalue.
TOLERANCE = 1e-12
#: Vectors that the block holds beyond the components, which keep it apart from the rest.
GUARD = 8
#: Rounds without a residual half as large as the best before, after which rounding is all that is left.
STALLED = 4


def scaled(vectors: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """Integers of the vectors' entries."""
    out = np.floor(vectors * scale)
    if out.size and np.abs(out).max() >= 1 << 52:
        raise ValueError("an entry is too large for exact integers")
    return out.astype(np.int64) + shift


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of what ``block`` spans beyond ``against``, itself
    orthonormal. Columns that add nothing to the others are left out."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # once more for what rounding left
        if against is not None and block.shape[1]:
            block = block - against @ (against.T @ block)
    if not block.shape[1]:
        return block
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, size > 1e-10]
    if against is not None and left.shape[1]:
        left = left - against @ (against.T @ left)
        left, _ = np.linalg.qr(left)
    return left


def lobpcg(product, size: int, count: int, tolerance: float = TOLERANCE):
    """(eigenvalues, vectors, residuals over the largest eigenvalue) of the
    ``count`` leading eigenvectors of a symmetric positive matrix of ``size``
    rows, of which only ``product(block)`` is known."""
    width = min(size, count + GUARD)
    x = orthonormal(np.random.default_rng(0).standard_normal((size, width)))
    vx, fresh, p, best, stalled = product(x), True, np.zeros((size, 0)), np.inf, 0
    while True:
        value, turn = np.linalg.eigh(x.T @ vx)
        value, turn = value[::-1], turn[:, ::-1]
        x, vx = x @ turn, vx @ turn
        residual = vx - x * value
        error = np.linalg.norm(residual[:, :count], axis=0)
        top = max(float(value[0]), 0.0)
        small = bool((error <= tolerance * top).all())
        if fresh:
            stalled = stalled + 1 if error.max() > best / 2 else 0
            best = min(best, float(error.max()))
            if small or stalled >= STALLED:
                return value[:count], x[:, :count], error / top if top else error
        elif small or stalled >= STALLED:
            x, _ = np.linalg.qr(x)
            vx, fresh = product(x), True
            continue
        more = orthonormal(np.concatenate((residual, p), axis=1), x)
        if not more.shape[1]:  # the space is whole already
            x, _ = np.linalg.qr(x)
            vx, fresh, p, stalled = product(x), True, np.zeros((size, 0)), STALLED
            continue
        vmore = product(more)
        basis, vbasis = np.concatenate((x, more), axis=1), np.concatenate((vx, vmore), axis=1)
        small_matrix = basis.T @ vbasis
        _, turn = np.linalg.eigh((small_matrix + small_matrix.T) / 2)
        turn = turn[:, ::-1][:, : x.shape[1]]
        p = more @ turn[x.shape[1] :]
        x, vx, fresh = basis @ turn, vbasis @ turn, False


class Whitener:
    """Fitted on a table of vectors; ``apply`` whitens its rows, or others of
    the same length."""

    def __init__(self, spark: SparkSession, vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 32):
        ship_package(spark)
        self.spark, self.vector, self.scale, self.shift, self.most = spark, vector, scale, shift, components

    def fit(self, df: DataFrame) -> Whitener:
        """Learn from all rows of ``df`` that take part."""
        self.rows, self.length = taking_part(df.select(self.vector), self.vector)
        self._sums()
        self.values, self.vectors, self.residuals = np.zeros(0), np.zeros((self.length, 0)), np.zeros(0)
        self.trace, self.identity_error = 0.0, 0.0
        if not self.n or not self.length:
            return self
        value, vectors, residuals = lobpcg(self._product, self.length, min(self.most, self.length))
        real = value > max(float(value[0]), 0.0) * self.length * np.finfo(float).eps * 8
        self.values, self.vectors, self.residuals = value[real], vectors[:, real], residuals[real]
        if len(self.values):
            self._check()
        return self

    def _cells(self, make, size: int) -> np.ndarray:
        """Sum over all tasks of an array of ``size`` cells that ``make``
        returns for the vectors of one batch."""
        vector, length = self.vector, self.length

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, met = np.zeros(size), False
            for batch in batches:
                if batch.num_rows:
                    total += make(matrix(batch.column(vector), length))
                    met = True
            if met:
                yield pa.record_batch([pa.array(np.arange(size, dtype=np.int64)), pa.array(total)], ["cell", "value"])

        summed = self.rows.mapInArrow(cells, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(size)
        out[np.asarray(summed["cell"])] = np.asarray(summed["value"])
        return out

    def _sums(self) -> None:
        """Number of rows, exact sums, and the largest entry."""
        vector, length, scale, shift = self.vector, self.length, self.scale, self.shift

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = scaled(matrix(batch.column(vector), length), scale, shift)
                if len(x):
                    total = np.append(x.sum(0), len(x))
                    most = np.append(np.abs(x).max(0), 0)
                    yield pa.record_batch([pa.array(np.arange(length + 1)), pa.array(total), pa.array(most)], ["cell", "total", "most"])

        found = self.rows.mapInArrow(sums, "cell long, total long, most long").groupBy("cell").agg(F.sum("total").alias("total"), F.max("most").alias("most")).toArrow()
        total = np.zeros(length + 1, np.int64)
        total[np.asarray(found["cell"])] = np.asarray(found["total"])
        self.n, self.sums = int(total[-1]), total[:-1]
        most = max(found["most"].to_pylist(), default=0)
        if self.n * most >= 1 << 61:
            raise ValueError("too many rows, or too large entries, for exact distances from the mean")

    def _centred(self):
        """A function from vectors to their exact distances from the mean, times n."""
        n, sums, scale, shift = self.n, self.sums, self.scale, self.shift
        return lambda vectors: n * scaled(vectors, scale, shift) - sums

    def _product(self, block: np.ndarray) -> np.ndarray:
        """Covariance times ``block``; the trace, and the mean of the centred
        rows, which only rounding keeps from 0, come along."""
        centred, n, sent = self._centred(), self.n, self.spark.sparkContext.broadcast(block)
        length, width = block.shape

        def make(vectors: np.ndarray) -> np.ndarray:
            y = centred(vectors) / n
            return np.concatenate(((y.T @ (y @ sent.value)).ravel(), y.sum(0), [float((y * y).sum())]))

        found = self._cells(make, length * width + length + 1) / n
        self.trace, self.mean = float(found[-1]), found[length * width : -1]
        return found[: length * width].reshape(length, width)

    def _turn(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def _check(self) -> None:
        """Largest entry of the whitened rows' covariance minus the identity."""
        centred, n, sent = self._centred(), self.n, self.spark.sparkContext.broadcast((self._turn(), self.mean))
        count = len(self.values)

        def make(vectors: np.ndarray) -> np.ndarray:
            turn, mean = sent.value
            w = (centred(vectors) / n) @ turn - mean @ turn
            return (w.T @ w).ravel()

        self.identity_error = float(np.abs(self._cells(make, count * count).reshape(count, count) / n - np.eye(count)).max())

    def apply(self, df: DataFrame, out: str = "white") -> DataFrame:
        """The rows of ``df`` that take part, with a column ``out`` of (deviation
        long, values array<double>, one for each component)."""
        centred, n, sent = self._centred(), self.n, self.spark.sparkContext.broadcast(self._turn())
        length = self.length

        def whiten(column: pa.Array) -> pa.Array:
            y = centred(matrix(column, length))
            most = int(np.abs(y).max(initial=0))
            if most * most * length < 1 << 63:
                deviation = pa.array((y * y).sum(1), pa.int64())
            else:
                exact = [sum(v * v for v in row) for row in y.tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            w = (y / n if n else y * 1.0) @ sent.value
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            return pa.StructArray.from_arrays([deviation, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["deviation", "values"])

        rows, found = taking_part(df, self.vector)
        rows = rows.where(F.lit(found == length))
        return rows.withColumn(out, F.arrow_udf(whiten, "deviation long, values array<double>")(F.col(self.vector)))
