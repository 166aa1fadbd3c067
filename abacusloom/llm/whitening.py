"""Whitening of embeddings by pivoted Cholesky of the centred scatter and one-sided Jacobi on its triangular factor.

Entries are quantised to whole numbers (``floor(64 c) + 1,000,000``), and the model is fit on each distinct vector once. With whole numbers every sum over
rows is exact, whatever the order or partitioning in which Spark adds them up: sums first, then the scatter of vectors centred by the rounded mean,
whose last fraction is taken out in whole numbers too. Products are made by matrix multiplication in doubles, over as few rows at a time as keep
them exact.

Only the scatter, a square of the dimension, goes to the driver. There the Cholesky factor ``L`` with diagonal pivots (``V = L L'`` in pivoted
order, up to the rank) is rotated from the right until its columns are orthogonal. Rotations don't change ``L L'``, so the columns'
squared norms are the eigenvalues of ``V`` and the normalised columns its eigenvectors; small eigenvalues come out as precisely as large ones, as no
product ``L' L`` is formed.

Rows whose vector is null or has null or non-finite entries are dropped; so are vectors of another length than the most frequent one (of equally
frequent lengths the longest). Entries beyond 10^13 count as 10^13. Components of no variance are left out; where nothing varies, or the table is
empty, there are none. Rows of equal key, and a null key, are rows like others. Only the key and the vector are read, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

COMPONENTS = 16
SCALE, SHIFT, MOST = 64, 1_000_000, 10**13
EXACT = 2**53  # whole numbers below it are exact in doubles
ROWS = 4_096  # vectors multiplied at a time, at most


def finite(vector: str) -> Column:
    """Whether a vector has entries, all of them finite."""
    odd = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, odd)


def quantised(vector: str) -> Column:
    held = lambda c: F.greatest(F.least(c.cast("double"), F.lit(float(MOST))), F.lit(float(-MOST)))
    return F.transform(vector, lambda c: F.floor(held(c) * SCALE) + SHIFT)


def vectors_of(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, dims)


def gram(z: np.ndarray) -> np.ndarray:
    """``z' z`` of whole numbers as Python's, exactly."""
    total = np.zeros((z.shape[1],) * 2, object)
    largest = int(np.abs(z).max(initial=1)) or 1
    rows = min(ROWS, EXACT // largest**2)
    if not rows:  # a single product is too large for a double
        z = z.astype(object)
        return sum((np.outer(x, x) for x in z), total)
    for at in range(0, len(z), rows):
        part = z[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


@dataclass(frozen=True)
class Model:
    """``n`` distinct vectors with sums ``sums``; ``eigen`` values by falling size, ``axes`` with a column for each, and the ``trace``."""

    n: int
    sums: tuple[int, ...]
    eigen: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def projection(self) -> np.ndarray:
        return self.axes / np.sqrt(self.eigen)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S/n`` in doubles: whole part first, so that nothing cancels."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of ``(n x - S)^2`` of each row, exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        z = x - whole
        if (int(np.abs(z).max(initial=0)) + 1) ** 2 * self.n**2 * x.shape[1] < 2**63:
            return ((self.n * z - rest) ** 2).sum(axis=1).tolist()
        return [sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(row, rest, strict=True)) for row in z]


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """``L`` with ``L L'`` equal to a positive semidefinite matrix, its rows in the matrix' order: triangular with its rows in pivot order, and as many
    columns as the rank."""
    left = scatter.astype(np.float64).copy()
    d = len(left)
    order, out = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(left.diagonal().max(initial=0), 0)
    for k in range(d):
        at = k + int(np.argmax(left.diagonal()[order[k:]]))
        order[[k, at]] = order[[at, k]]
        pivot, below = order[k], order[k + 1 :]
        if left[pivot, pivot] <= least:
            return out[:, :k]
        out[pivot, k] = np.sqrt(left[pivot, pivot])
        out[below, k] = left[below, pivot] / out[pivot, k]
        left[np.ix_(below, below)] -= np.outer(out[below, k], out[below, k])
    return out


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms and normalised columns of ``factor`` after its columns were rotated, pair by pair, until they are orthogonal; by falling norm.
    The pairs of a round (as in a tournament) share no column and are rotated together."""
    g = factor.copy()
    r = g.shape[1]
    seats = np.arange(r + r % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            a, b = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            real = (a < r) & (b < r)
            p, q = np.minimum(a, b)[real], np.maximum(a, b)[real]
            pp, qq, pq = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            near = np.abs(pq) / np.sqrt(pp * qq)
            worst = max(worst, near.max(initial=0))
            turn = near > np.finfo(float).eps
            p, q, pp, qq, pq = (x[turn] for x in (p, q, pp, qq, pq))
            zeta = (qq - pp) / (2 * pq)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta**2))
            c = 1 / np.sqrt(1 + t**2)
            s = c * t
            g[:, p], g[:, q] = c * g[:, p] - s * g[:, q], s * g[:, p] + c * g[:, q]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= 1e-15 * max(1, len(g)):
            break
    norms = np.sqrt((g**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, (g / norms)[:, order]


def _sums(lists: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows and sums of each dimension: a task hands on one row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            n += batch.num_rows
            total += vectors_of(batch, 0, dims).astype(object).sum(axis=0) if batch.num_rows else 0
        columns = [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(total.tolist(), pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "n", "total"])

    small_batches(lists.sparkSession)
    found = lists.select("x").mapInArrow(run, "i int, n long, total decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    by_dim = {r["i"]: r for r in found}
    return (by_dim[0]["n"], [int(by_dim[i]["total"]) for i in range(dims)]) if by_dim else (0, [0] * dims)


def _scatter(lists: DataFrame, centre: list[int], dims: int) -> np.ndarray:
    """The scatter of vectors about ``centre``: a task hands on one row for each pair of dimensions."""
    upper = np.triu_indices(dims)
    middle = np.array(centre, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            if batch.num_rows:
                total += gram(vectors_of(batch, 0, dims) - middle)
        columns = [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper].tolist(), pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])

    out = np.zeros((dims, dims), object)
    found = lists.select("x").mapInArrow(run, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))
    for i, j, total in found.collect():
        out[i, j] = out[j, i] = int(total)
    return out


def fit(lists: DataFrame, dims: int) -> Model:
    """The model of distinct vectors ``x`` of whole numbers, ``dims`` each. Work on the driver depends on the dimension only."""
    n, sums = _sums(lists, dims)
    if not n:
        return Model(0, tuple(sums), np.empty(0), np.empty((dims, 0)), 0.0)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]  # what the rounded centre leaves of the sums
    about = _scatter(lists, centre, dims)
    covariance = np.array([[float(Fraction(n * about[i, j] - rest[i] * rest[j], n * n)) for j in range(dims)] for i in range(dims)])
    eigen, axes = jacobi(pivoted_cholesky(covariance))
    return Model(n, tuple(sums), eigen, axes, float(Fraction(sum(n * about[i, i] - rest[i] ** 2 for i in range(dims)), n * n)))


def identity_error(lists: DataFrame, model: Model, components: int) -> float:
    """The largest absolute entry of the covariance of whitened distinct vectors less the identity, measured on those vectors."""
    dims, k = len(model.sums), min(components, len(model.eigen))
    if not k:
        return 0.0
    w = model.projection[:, :k]
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y = model.centred(vectors_of(batch, 0, dims)) @ w
            total, sums = total + y.T @ y, sums + y.sum(axis=0)
        columns = [pa.array([*upper[0], *range(k)], pa.int32()), pa.array([*upper[1], *[-1] * k], pa.int32()), pa.array([*total[upper], *sums])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])

    found = lists.select("x").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    of = {(i, j): total / model.n for i, j, total in found}
    return max(abs(of[i, j] - of[i, -1] * of[j, -1] - (i == j)) for i, j in zip(*upper, strict=True))


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, Model, float]:
    """A row for each row that remains, with ``key``, ``x`` (quantised), ``deviation`` (null if beyond a long) and ``whitened`` (an array of up to ``components`` doubles); the model;
    and the identity error of the distinct vectors."""
    spark = rows.sparkSession
    clean = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(finite("v")).select("id", quantised("v").alias("x"))
    lengths = clean.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths["dims"] if lengths else 0
    clean = clean.filter(F.size("x") == dims)
    lists = materialise(clean.select("x").distinct())
    model = fit(lists, dims)
    k = min(components, len(model.eigen))
    w = model.projection[:, :k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors_of(batch, 1, dims)
            y = model.centred(x) @ w
            of = [d if d < 2**63 else None for d in model.deviations(x)]
            ends = pa.array(np.arange(len(x) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(y.reshape(-1)))], ["id", "x", "deviation", "whitened"])

    small_batches(spark)
    kind = rows.select(F.col(key)).schema[0].dataType.simpleString()
    out = clean.mapInArrow(run, f"id {kind}, x array<long>, deviation long, whitened array<double>").withColumnRenamed("id", key)
    return out, model, identity_error(lists, model, components)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every remaining vector's first sixteen whitened components."""
    found, model, error = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigen[:COMPONENTS])).cast("array<double>")
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
