"""Packing of token sequences into windows by multiway differencing.

A document is cut into whole windows and one remainder. The remainders of a task are collected until they fill a
number of windows and are then dealt to these by the Karmarkar-Karp differencing method: partial partitions with the
largest imbalance are merged with opposing order, which leaves windows of nearly equal size. Where cuts are allowed,
what stands out of a window is cut off and fills the others; where they aren't, the window count rises until
everything fits. What is more than whole windows waits for the next remainders, so only the last windows of a task
are padded. Nothing is shuffled.

Nulls and empty texts are sequences of the end id alone. Repeated rows are packed once for each row. An empty table
gives no pieces. Columns other than the id and the text are ignored. A text longer than a window spans several.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.arrays import slices, text_column
from mailquarry.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
WINDOW = 1024
BATCH_WINDOWS = 128         # windows that are filled at once
BATCH_ITEMS = 2048          # or as many remainders, if they are short
SEQUENCE_BITS = 36          # sequences of one task; the bits above hold the task's partition


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of the sizes in ``ways`` groups of nearly equal sum (multiway differencing)."""
    empty = np.zeros(ways - 1, np.int64)
    heap = [(-size, i, np.concatenate([[size], empty]), [[i], *([] for _ in range(ways - 1))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, sums, groups = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        merged = sums + other[::-1]                      # the largest of one meets the smallest of the other
        order = np.argsort(-merged, kind="stable")
        joined = [a + b if a and b else a or b for a, b in zip(groups, reversed(others), strict=True)]
        merged = merged[order]
        heapq.heappush(heap, (int(merged[-1] - merged[0]), number, merged, [joined[k] for k in order.tolist()]))
        number += 1
    return heap[0][3] if heap else [[] for _ in range(ways)]


def windows_of(sizes: list[int], capacity: int, cuts: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, from, to) parts of the sizes; no window holds more than the capacity.

    Without cuts every size has to fit into a window.
    """
    if not sizes:
        return []
    count = max(1, -(-sum(sizes) // capacity))
    groups = difference(sizes, count)
    while not cuts and max(sum(sizes[i] for i in g) for g in groups) > capacity:
        count += 1
        groups = difference(sizes, count)
    windows, over = [], []
    for group in groups:
        parts, room = [], capacity
        for i in sorted(group, key=lambda i: -sizes[i]):
            take = min(room, sizes[i])
            if take:
                parts.append((i, 0, take))
            if take < sizes[i]:
                over.append((i, take, sizes[i]))
            room -= take
        windows.append((parts, room))
    for parts, room in windows:
        while room and over:
            i, a, b = over.pop()
            take = min(room, b - a)
            parts.append((i, a, a + take))
            if a + take < b:
                over.append((i, a + take, b))
            room -= take
    return [parts for parts, _ in windows if parts]


class _Packer:
    """The remainders that wait, and the pieces that are ready."""

    def __init__(self, window: int, first: int) -> None:
        self.window, self.next, self.waiting, self.tokens, self.rows = window, first, [], 0, []

    def piece(self, doc, start: int, ids: np.ndarray, total: int, offset: int) -> None:
        self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, offset))

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self.piece(doc, start, ids[start:start + self.window], len(ids), 0)
            self.next += 1
        if whole < len(ids):
            self.waiting.append((doc, whole, ids[whole:].copy(), len(ids)))
            self.tokens += len(ids) - whole
            if self.tokens >= BATCH_WINDOWS * self.window or len(self.waiting) >= BATCH_ITEMS and self.tokens >= self.window:
                self.flush(last=False)

    def flush(self, last: bool) -> None:
        left, kept = 0 if last else self.tokens % self.window, []
        while left:                                      # what fills no window waits
            doc, start, ids, total = self.waiting.pop()
            cut = max(0, len(ids) - left)
            kept.append((doc, start + cut, ids[cut:], total))
            left -= len(ids) - cut
            if cut:
                self.waiting.append((doc, start, ids[:cut], total))
        for parts in windows_of([len(x[2]) for x in self.waiting], self.window):
            offset = 0
            for i, a, b in parts:
                doc, start, ids, total = self.waiting[i]
                self.piece(doc, start + a, ids[a:b], total, offset)
                offset += b - a
            self.next += 1
        self.waiting, self.tokens = kept, sum(len(x[2]) for x in kept)

    def batch(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it comes from, its ids (little-endian, 32 bits) and its place in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(window, TaskContext.get().partitionId() << SEQUENCE_BITS)
        for batch in batches:
            for part in slices(batch):
                ids, borders = encoder(tokenizer).encode(text_column(part).to_pylist())
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    packer.add(doc, ids[borders[k]:borders[k + 1]])
                yield packer.batch()
        packer.flush(last=True)
        yield packer.batch()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, PIECES)
