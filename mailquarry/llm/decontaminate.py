"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

Texts and items are compared in lower case (A-Z) with every run of ASCII white space as one blank, as UTF-8 bytes. An item
of n bytes may differ by k = n // ERROR_SPAN edits and is split into k + 1 pieces: of k edits at least one piece is free,
so it stands in the text unchanged. The pieces' first bytes are found by a rolling hash, each hit is compared with the
whole piece, and the surroundings of a hit are verified with Myers' bit-parallel distance.

The items are handled in blocks of about ``BLOCK_ITEMS``, each a pass over the texts; documents are never shuffled. Null
texts match nothing. Null items and items without a visible character are left out; items shorter than ERROR_SPAN match
exactly. Repeated items with different ids each give a match, repeated documents get equal matches. Other columns are
passed on or ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.arrays import K1, _BLANK, forget, lowered, owner, powers, prefix_hash, slices, text_column, utf8

ERROR_SPAN = 14             # one edit for so many bytes
SEED = 12                   # bytes of a piece that are looked up
BLOCK_ITEMS = 20_000
TABLE_BITS = 22
MATCHES = "doc_id long, item_id long, distance int, start long, stop long"


def squeezed(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their borders, and the place of each in the text's own bytes."""
    low = lowered(data)
    blank = _BLANK[low]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    first = borders[:-1][borders[:-1] < borders[1:]]
    keep[first] = True
    low[blank] = 32
    at = np.flatnonzero(keep)
    return low[at], np.concatenate([[0], np.cumsum(keep)])[borders], at


def plain(text: str) -> bytes:
    """Normalised bytes of one item, without blanks at its ends."""
    return b" ".join(bytes(lowered(np.frombuffer(text.encode(), np.uint8))).split(None))


def distance(item: bytes, window: bytes, most: int) -> tuple[int, int] | None:
    """Least edit distance of the item to any part of the window, and where the first such part ends; None above ``most``."""
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score, best, end = full, 0, len(item), len(item) + 1, 0
    for j, c in enumerate(window):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
    if len(item) <= best:                               # no part is better than none
        best, end = len(item), 0
    return (best, end) if best <= most else None


class Index:
    """Pieces of the items of one block, by the hash of their first bytes."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.items = items
        by_size: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for i, (_, text) in enumerate(items):
            count = len(text) // ERROR_SPAN + 1
            cuts = [len(text) * j // count for j in range(count + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                size = min(SEED, b - a)
                by_size[size].append((self._hash(text[a:a + size]), i, a, b))
        self.classes = []
        for size, pieces in by_size.items():
            pieces.sort()
            keys = np.array([p[0] for p in pieces], np.uint64)
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            self.classes.append((size, keys, pieces, table))

    @staticmethod
    def _hash(seed: bytes) -> int:
        return int((prefix_hash(np.frombuffer(seed, np.uint8))[-1:] * K1)[0])

    def find(self, data: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, stop) of every text and item that match, best place first in the text."""
        prefix, raw = prefix_hash(data), data.tobytes()
        inverse = powers(len(prefix))[1]
        tried: dict[tuple[int, int], set[int]] = defaultdict(set)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for size, keys, pieces, table in self.classes:
            if len(data) < size:
                continue
            h = (prefix[size:] - prefix[:-size]) * inverse[:len(data) - size + 1] * K1
            for at in np.flatnonzero(table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]).tolist():
                k = int(np.searchsorted(keys, h[at]))
                while k < len(keys) and keys[k] == h[at]:
                    _, i, a, b = pieces[k]
                    k += 1
                    item = self.items[i][1]
                    if raw[at:at + b - a] != item[a:b]:
                        continue
                    text = int(owner(borders, at))
                    low, high = int(borders[text]), int(borders[text + 1])
                    if at + b - a > high:
                        continue
                    most = len(item) // ERROR_SPAN
                    if at - a in tried[text, i]:
                        continue
                    tried[text, i].add(at - a)
                    begin = max(low, at - a - most)
                    got = distance(item, raw[begin:min(high, at - a + len(item) + most)], most)
                    if got:
                        stop = begin + got[1]
                        back = distance(item[::-1], raw[begin:stop][::-1], got[0])
                        start = stop - (back[1] if back else len(item))
                        new = (got[0], start - low, stop - low)
                        best[text, i] = min(best.get((text, i), new), new)
        for (text, i), (d, start, stop) in sorted(best.items()):
            yield text, i, d, start, stop


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The items (item_id, text) in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    count = -(-items.count() // BLOCK_ITEMS)
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()
        found = sorted({(r.item_id, plain(r.text)) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield Index([x for x in found if x[1]])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds: distance, and where the best place is in the normalised bytes."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], MATCHES)
    for index in blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)           # bounded by BLOCK_ITEMS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    data, borders, _ = squeezed(*utf8(text_column(part)))
                    rows = list(shared.value.find(data, borders))
                    ids = part.column("doc_id")
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([shared.value.items[r[1]][0] for r in rows], pa.int64()),
                         pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                        ["doc_id", "item_id", "distance", "start", "stop"])

        found = found.unionByName(docs.mapInArrow(run, MATCHES))
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    spark = docs.sparkSession
    for index in blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)           # bounded by BLOCK_ITEMS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in batches:
                for part in slices(batch):
                    data, borders, _ = squeezed(*utf8(text_column(part)))
                    keep = np.ones(part.num_rows, bool)
                    keep[[r[0] for r in shared.value.find(data, borders)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
