"""Product quantization in whole numbers: codebooks and codes of vectors, exact at every step.

Vectors are scaled to integers and cut into ``PARTS`` equal parts. Each part has a codebook, at first that part of the
vectors with the smallest ids. A round assigns every part to its nearest entry and replaces the entry by the floor of the
mean of its parts. Squared distances come from dot products by limb-split matrix products (see ``limbs``), so they are
exact and ties go to the lower index. Tasks send one partial sum per entry; the codebooks, whose size is a parameter,
are all that passes through the driver.

Vectors that are null or hold null or non-finite components are dropped, and so are those of another length than the most
common one. A length that is no multiple of the number of parts is filled up with zeros. Fewer vectors than entries give
smaller codebooks. Ids are ordered with nulls last; rows with one id by their vectors. Repeated rows count each. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm import limbs
from mailquarry.plans.staging import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4


def _parts(batch: pa.RecordBatch, size: int, scale: int, parts: int) -> Iterator[np.ndarray]:
    """The rows of the batch as integers (rows, parts, width)."""
    width = -(-size // parts)
    for start in range(0, batch.num_rows, limbs.ROWS):
        x = limbs.matrix(batch.slice(start, limbs.ROWS), size, scale)
        yield np.pad(x, ((0, 0), (0, width * parts - size))).reshape(-1, parts, width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every row and part, and its squared distance."""
    index, error = (np.empty(x.shape[:2], np.int64) for _ in range(2))
    for p in range(x.shape[1]):
        d = limbs.distances(x[:, p], books[p])
        index[:, p] = d.argmin(1)                        # the first of equal ones
        error[:, p] = d[np.arange(len(d)), index[:, p]]
    return index, error


def _moved(vectors: DataFrame, size: int, scale: int, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round. Entries without a part stay."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)            # parts x entries x width integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, object)
        for batch in batches:
            for x in _parts(batch, size, scale, parts):
                index, _ = nearest(x, shared.value)
                for p in range(parts):
                    order = np.argsort(index[:, p], kind="stable")
                    entry, first, n = np.unique(index[order, p], return_index=True, return_counts=True)
                    if limbs.largest(x) * len(x) >= 1 << 63:
                        raise OverflowError("sums exceed 64 bits")
                    total[p, entry] += np.add.reduceat(x[order, p], first).astype(object)
                    count[p, entry] += n
        p, e = np.nonzero(count)
        if len(p):
            sums = pa.array([list(map(str, row)) for row in total[p, e]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), sums], ["part", "entry", "n", "sums"])

    sent = vectors.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    flat = sent.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
    moved = flat.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    new = books.copy()
    for r in moved.collect():                            # parts x entries x width rows
        new[r.part, r.entry, r.place] = int(r.total) // r.n
    shared.unpersist()
    return new


def train(vectors: DataFrame, size: int, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of rows with columns vec_id and vector; None without rows."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    if not first:
        return None
    batch = pa.RecordBatch.from_arrays([pa.array([r.vector for r in first], pa.list_(pa.float64()))], ["vector"])
    books = np.ascontiguousarray(np.concatenate(list(_parts(batch, size, scale, parts))).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(vectors, size, scale, books)
    return books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal digits."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def assign(vectors: DataFrame, size: int, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part, more for codebooks of over 256 entries) and error of every row."""
    parts, entries = books.shape[:2]
    digits = max(2, -(-(entries - 1).bit_length() // 4))
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _parts(batch, size, scale, parts):
                index, error = nearest(x, shared.value)
                own = batch.slice(at, len(x))
                at += len(x)
                if float(error.astype(np.float64).sum(1).max(initial=0)) >= 2.0 ** 62:
                    raise OverflowError("errors exceed 62 bits")
                code = ["".join(f"{k:0{digits}x}" for k in row) for row in index.tolist()]
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(code, pa.string()), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long")


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings: int) -> DataFrame:
    """vec_id, code, error, label_error (errors of all rows with one label, null labels together) and codebooks_sha256."""
    vectors, size = limbs.kept(rows, id_col, vector_col, F.col(label_col).alias("label"))
    vectors = written(vectors)
    books = train(vectors, size, **settings) if size else None
    if books is None:
        empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return rows.sparkSession.createDataFrame([], empty)
    coded = written(assign(vectors, size, books, settings.get("scale", SCALE)))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "other")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("other")))          # one row per label
    return joined.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
