"""Exact integer matrix products by floating-point BLAS, and vectors of embeddings as Arrow batches.

An integer is split into limbs so small that a sum of products of two limbs stays below 2**53 and is exact in double
precision. The products of the limbs are put together again in 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANTISSA = 53
ROWS = 4096                 # rows of a batch that are worked on at once


def limb_bits(inner: int) -> int:
    """Bits of a limb, if so many products are summed."""
    return (MANTISSA - max(1, inner - 1).bit_length()) // 2


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Doubles whose sum, each times ``2 ** (bits * place)``, is the integer; the last limb has the sign."""
    out, rest = [], x
    while largest(rest) > 1 << bits:
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of 64-bit integers, exact; the entries have to fit into 64 bits."""
    bits = limb_bits(a.shape[1])
    if largest(a) * largest(b) * a.shape[1] >= 1 << 63:
        raise OverflowError("dot products exceed 64 bits")
    out = np.zeros((a.shape[0], b.shape[1]), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y).astype(np.int64) << (bits * (i + j))
    return out


def distances(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of every row to every entry, exact."""
    if (largest(v) + largest(book)) ** 2 * v.shape[1] >= 1 << 63:
        raise OverflowError("squared distances exceed 64 bits")
    return (v * v).sum(1)[:, None] - 2 * product(v, book.T) + (book * book).sum(1)


def usable(column: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    c = F.col(column)
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def kept(rows: DataFrame, id_col: str, vector_col: str, *others: Column) -> tuple[DataFrame, int]:
    """vec_id, vector (doubles) and other columns of the usable rows, and the dimension.

    If lengths differ, the vectors of the most common length are kept (of equally common ones the greatest).
    """
    out = rows.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), *others)
    top = out.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = top["size"] if top else 0
    return out.where(F.size("vector") == size), size


def matrix(batch: pa.RecordBatch, size: int, scale: int, shift: int = 0) -> np.ndarray:
    """``floor(scale * vector) + shift`` of every row, as integers."""
    x = np.floor(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * scale)
    if x.size and np.abs(x).max() >= 2.0 ** 62:
        raise OverflowError("components exceed 62 bits")
    return x.astype(np.int64) + shift
