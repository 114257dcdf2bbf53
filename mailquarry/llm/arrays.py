"""Texts of an Arrow batch as flat numpy arrays, in slices of bounded size.

All text operators that run in Python work on these: one array with the bytes of many texts and one with
their borders, so the cost per text is a few array operations and never a Python loop over characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20       # of the Arrow batches that Spark sends to Python and takes back
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
SLICE_BYTES = 1 << 19
K1 = np.uint64(0x9E3779B97F4A7C15)      # odd multipliers of the hash functions below
K2 = np.uint64(0xBF58476D1CE4E5B9)
K3 = np.uint64(0x94D049BB133111EB)
BASE = 0x2545F4914F6CDD1D               # base of the rolling hash, odd so that it has an inverse
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_KEPT: dict[str, object] = {}


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes, so that long texts don't make them large; a limit that the session has stays."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def kept(key: str, make: Callable[[], object]) -> object:
    """What this Python worker has made under that key; it stays for the worker's later tasks until :func:`forget`."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what :func:`kept` has, which tasks of another operator would hold beside their own memory."""
    _KEPT.clear()


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column, nulls as empty texts."""
    return pc.fill_null(batch.column(name), "")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their ``len + 1`` borders, without a copy."""
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    borders = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[borders[0]:borders[-1]], borders - borders[0]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``limit`` bytes of text; one longer text is a range of its own."""
    _, borders = utf8(text_column(batch, name))
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(borders, borders[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 bits of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * K2
    x ^= x >> np.uint64(27)
    x *= K3
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of BASE and of its inverse, modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << max(10, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("_POWERS", BASE), ("_INVERSES", pow(BASE, -1, 1 << 64))):
                grown = np.full(size, base, np.uint64)
                grown[0] = 1
                globals()[name] = np.multiply.accumulate(grown)
    return _POWERS[:n], _INVERSES[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash, ``len + 1`` entries; see :func:`span_hash`."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * K1 * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of every span ``[start, stop)``; equal spans have equal hashes wherever they stand."""
    return (prefix[stop] - prefix[start]) * powers(len(prefix))[1][start] + (stop - start).astype(np.uint64) * K3


def owner(borders: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position."""
    return np.searchsorted(borders, position, side="right") - 1


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint8)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[data]


def words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs without ASCII white space, and the text of each."""
    inside = ~_BLANK[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = borders[:-1][borders[:-1] < borders[1:]]
    start[first] = inside[first]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = borders[1:][borders[:-1] < borders[1:]] - 1
    stop[last] = inside[last]
    begin = np.flatnonzero(start)
    return begin, np.flatnonzero(stop) + 1, owner(borders, begin)


def word_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of every span of at least one byte, eight bytes at a time; every chunk is mixed with its place before it is added."""
    size = stop - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    chunks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    n = (size + 7) >> 3
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    chunk = chunks[np.repeat(start, n) + 8 * place]
    unused = 8 * (8 * n - size).astype(np.uint64)
    last = first + n - 1
    chunk[last] = (chunk[last] << unused) >> unused
    h = mix(chunk ^ mix((place + 1).astype(np.uint64) * K1))
    return mix(np.add.reduceat(h, first) + size.astype(np.uint64) * K3) if len(size) else h
