"""Whitening of embeddings with a covariance that is exact and eigenvectors that are refined in higher precision.

Components are scaled to integers. Tasks sum them and, centred at the rounded mean, their products; both sums are exact,
so the covariance is one rounding away from the true one. Single-precision eigenvectors are corrected by the iteration
of Ogita and Aishima, matrix products alone, in extended precision. Eigenvalues closer together than the error bound are
a cluster: its basis is made orthonormal and then turned by the eigenvectors of the small matrix that the cluster spans.
Only sums over all rows pass through the driver, as many as the dimension squared.

Vectors that are null or hold null or non-finite components are dropped, and so are those of another length than the most
common one. Components without variance (a dimension that never changes, fewer rows than dimensions) are whitened to 0.
Repeated rows count each, null ids are kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm import limbs
from mailquarry.plans.staging import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
MAX_STEPS = 40
_DECIMAL = pa.decimal128(38, 0)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _cells(total: np.ndarray, n: int) -> pa.RecordBatch:
    """Sums of a task, one row per entry."""
    keys = np.arange(total.size, dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([Decimal(int(v)) for v in total.reshape(-1)], _DECIMAL), pa.array(np.full(total.size, n))], ["cell", "total", "n"])


def _summed(vectors: DataFrame, run) -> tuple[list[int], int]:
    """Exact totals of all tasks, by cell, and the number of rows."""
    cells = vectors.select("vector").mapInArrow(run, "cell int, total decimal(38,0), n long")
    rows = cells.groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("cell").collect()       # dimension squared
    return [int(r.total) for r in rows], rows[0].n if rows else 0


def sums(vectors: DataFrame, size: int) -> tuple[list[int], int]:
    """Sum of every dimension, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, object), 0
        for batch in batches:
            for start in range(0, batch.num_rows, limbs.ROWS):
                x = limbs.matrix(batch.slice(start, limbs.ROWS), size, SCALE, SHIFT)
                total += sum(((x >> shift) & 0xFFFFFFFF if shift == 0 else x >> shift).sum(0).astype(object) << shift for shift in (0, 32))
                n += len(x)
        if n:
            yield _cells(total, n)

    return _summed(vectors, run)


def products(vectors: DataFrame, size: int, centre: np.ndarray) -> list[int]:
    """Sums of products of all pairs of centred dimensions, row by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size), object), 0
        for batch in batches:
            for start in range(0, batch.num_rows, limbs.ROWS):
                z = limbs.matrix(batch.slice(start, limbs.ROWS), size, SCALE, SHIFT) - centre
                total += limbs.product(np.ascontiguousarray(z.T), z).astype(object)
                n += len(z)
        if n:
            yield _cells(total, n)

    return _summed(vectors, run)[0]


def _extended(value: Fraction) -> np.longdouble:
    high = float(value)
    return np.longdouble(high) + np.longdouble(float(value - Fraction(high)))


def clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Indices of eigenvalues that are no further apart than this, in chains; single ones are left out."""
    order = np.argsort(values)
    cut = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix in extended precision, from approximate vectors."""
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    one, size = np.eye(len(a), dtype=np.longdouble), np.sqrt((a.astype(np.longdouble) ** 2).sum())
    last = np.inf
    for number in range(MAX_STEPS):
        r, s = one - x.T @ x, x.T @ (a @ x)
        s = (s + s.T) / 2
        value = np.diag(s) / (1 - np.diag(r))
        apart = 2 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + size * np.sqrt((r ** 2).sum()))
        gap = value[None, :] - value[:, None]
        far = np.abs(gap) > apart
        change = np.triu(np.where(far, (s + value[None, :] * r) / np.where(far, gap, 1), r / 2), 1)
        change += np.tril(r - change.T, -1) + np.diag(np.diag(r) / 2)          # both halves add up to r, which keeps the basis orthonormal
        x = x + x @ change
        near = clusters(value, apart)
        for group in near:                               # turn the basis of the cluster, with its common value taken off
            middle = value[group].mean()
            small = x[:, group].T @ (a @ x[:, group] - middle * x[:, group])
            _, turn = np.linalg.eigh(((small + small.T) / 2 / max(np.abs(small).max(), np.finfo(float).tiny)).astype(np.float64))
            x[:, group] = x[:, group] @ turn.astype(np.longdouble)
        step = np.sqrt((change ** 2).sum())
        if step < 1e-17 * len(a) or number > 5 and step >= last / 2 and np.abs(r).max() < 1e-15:
            break
        last = step
    x = x + x @ (one - x.T @ x) / 2
    value = (x * (a @ x)).sum(0) / (x * x).sum(0)
    order = np.argsort(-value, kind="stable")
    x = x[:, order] / np.sqrt((x * x).sum(0))[order]
    flip = np.sign(x[np.abs(x).argmax(0), np.arange(len(a))])
    return value[order], x * np.where(flip == 0, 1, flip)


@dataclass
class Fit:
    """What whitening needs: rows, sums, an integer centre, eigenvalues and vectors of the first components, trace."""

    n: int
    totals: list[int]
    centre: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Fit | None:
    """Eigenvectors of the covariance of all rows (column vector); None without rows."""
    totals, n = sums(vectors, size)
    if not n:
        return None
    centre = [(2 * t + n) // (2 * n) for t in totals]
    offset = [t - n * c for t, c in zip(totals, centre, strict=True)]
    centre = np.array(centre, np.int64)
    gram = products(vectors, size, centre)
    covariance = np.array([_extended(Fraction(n * g - offset[k // size] * offset[k % size], n * n)) for k, g in enumerate(gram)]).reshape(size, size)
    top = np.abs(covariance).max()
    _, first = np.linalg.eigh((covariance / (top or 1)).astype(np.float32))
    values, turned = refined(covariance / (top or 1), first)
    return Fit(n, totals, centre, (values * top).astype(float)[:components], turned.astype(float)[:, :components], float(np.trace(covariance)))


def _projection(model: Fit) -> np.ndarray:
    """Eigenvectors over the roots of their eigenvalues; zero for components without variance."""
    least = max(model.values[0], 0) * len(model.centre) * np.finfo(float).eps
    some = model.values > least
    return np.where(some, model.vectors / np.sqrt(np.where(some, model.values, 1)), 0)


def deviations(z: np.ndarray, n: int, offset: list[int]) -> list[int]:
    """``sum((n * z - offset) ** 2)`` of every row, exact."""
    square = sum(r * r for r in offset)
    if limbs.largest(z) ** 2 * z.shape[1] < 1 << 62 and limbs.largest(z) * sum(map(abs, offset)) < 1 << 62:
        own = (z * z).sum(1).tolist()
        cross = (z @ np.array(offset, np.int64)).tolist()
    else:
        own, cross = (z.astype(object) ** 2).sum(1).tolist(), (z.astype(object) @ np.array(offset, object)).tolist()
    return [n * n * a - 2 * n * b + square for a, b in zip(own, cross, strict=True)]


def projected(vectors: DataFrame, size: int, model: Fit) -> DataFrame:
    """vec_id, deviation and the whitened components of every row."""
    offset = [t - model.n * int(c) for t, c in zip(model.totals, model.centre, strict=True)]
    mean = np.array([float(Fraction(r, model.n)) for r in offset])
    shared = vectors.sparkSession.sparkContext.broadcast((model.centre, _projection(model)))           # dimension x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, turn = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, limbs.ROWS):
                part = batch.slice(start, limbs.ROWS)
                z = limbs.matrix(part, size, SCALE, SHIFT) - centre
                y = (z - mean) @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.reshape(-1)))
                exact = pa.array([Decimal(d) for d in deviations(z, model.n, offset)], _DECIMAL)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), exact, lists], ["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, n: int, components: int) -> float:
    """Largest difference between the covariance of the whitened rows and the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components))
        for batch in batches:
            y = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
            total[0] += y.sum(0)
            total[1:] += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], ["cell", "total"])

    cells = rows.select("whitened").mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).orderBy("cell").collect()
    total = np.array([r.total for r in cells]).reshape(components + 1, components) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(components)).max())       # the mean is 0 but for rounding


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component. A deviation beyond 64 bits is null; ``projected`` has it with 38 digits."""
    vectors, size = limbs.kept(rows, id_col, vector_col)
    vectors = written(vectors)
    model = fit(vectors, size, components) if size else None
    if model is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    turned = written(projected(vectors, size, model))
    error = identity_error(turned, model.n, len(model.values))
    share = F.array(*[F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values])
    flat = turned.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return flat.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
