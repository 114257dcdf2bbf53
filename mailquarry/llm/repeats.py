"""Removal of long repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere in the corpus. For every start the window of
LENGTH bytes is named by its anchor, the place of the least hash among its first ``SPAN`` places, so equal windows have
equal anchors. Starts with one anchor form an item; all its windows share a core of LENGTH + 1 - SPAN bytes from the
anchor on. Items whose core (by its hash) occurs once are done: this is what most of a corpus is.

The suffixes at the anchors of the other items are sorted in the tasks, equal ones are merged, and each task sends the
sorted run of each bucket front-coded: only what a suffix doesn't share with the one before it. A bucket's runs are
merged by a loser tree that reuses the common prefixes. The prefixes that neighbours share tell for every number of
bytes right of the anchor which suffixes agree, the same holds for the reversed bytes on its left, and a window is
repeated if its two parts agree with those of another one.

Equal texts are one text with a count. Strings equal within a task are sent once. A core with more than ``MOST`` different
suffixes is split by halving the range of starts, down to one, where only equal windows are left: no group has to fit
into one task. Spans are judged on the input.

Null texts are empty. Texts shorter than LENGTH are kept. Repeated rows repeat each other and lose all their bytes if
they are long enough. Empty tables give no rows. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.arrays import K1, K3, mix, owner, prefix_hash, slices, span_hash, text_column, utf8
from mailquarry.llm.bitmap import absent, bitmap, maybe
from mailquarry.llm.neardup import digest
from mailquarry.llm.suffixes import decoded, front_coded, merged, prefixes
from mailquarry.plans.staging import written

LENGTH = 400
SPAN = 256                  # places among which the anchor of a window is chosen; a power of two
GRAM = 16                   # bytes of a hashed place
BUCKET_ITEMS = 20_000       # items for each bucket, about
MOST = 50_000               # different suffixes of one core that a bucket takes
ITEM = "th binary, anchor long, low int, high int, width int, key long, whole long, n long"
_HEAD = struct.Struct("<II")
_ROW = np.dtype([("shared", "<u4"), ("rest", "<u4"), ("left", "<u4"), ("low", "<u4"), ("high", "<u4"), ("several", "u1"), ("th", "V16"), ("base", "<i8")])


def anchors(data: np.ndarray, borders: np.ndarray, length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """Text, anchor and the range of starts (distances before the anchor) of every item."""
    n, gram = len(data), min(GRAM, length + 1 - span)
    sizes = np.diff(borders)
    if not (sizes >= length).any():
        return (np.zeros(0, np.int64),) * 4
    prefix = prefix_hash(data)
    h = np.full(n + 2 * span, np.iinfo(np.uint64).max, np.uint64)
    places = np.arange(n - gram + 1)
    h[:n - gram + 1] = (mix(span_hash(prefix, places, places + gram)) & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    rows = h[:len(h) // span * span].reshape(-1, span)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    starts = np.flatnonzero(np.repeat(borders[1:], sizes) - np.arange(n) >= length)
    least = (np.minimum(behind[starts], ahead[starts + span - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    anchor = least[first]
    text = owner(borders, anchor)
    return text, anchor - borders[text], anchor - starts[last], anchor - starts[first]


def keyed(prefix: np.ndarray, base: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each item's core and of all its bytes; ``base`` is where its text starts."""
    block = low // width
    core = base + anchor - block * width
    salt = mix(block.astype(np.uint64) + np.array([width], np.uint64) * K1)
    key = mix(span_hash(prefix, core, core + length + 1 - width) + salt)
    whole = mix(span_hash(prefix, base + anchor - high, base + anchor - low + length) + salt + low.astype(np.uint64) * K3)
    return key.astype(np.int64), whole.astype(np.int64)


def _items(rows: DataFrame, length: int, span: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, borders = utf8(text_column(part))
                text, anchor, low, high = anchors(data, borders, length, span)
                if len(text):
                    key, whole = keyed(prefix_hash(data), borders[text], anchor, low, high, span, length)
                    yield _item_batch(part.column("th").take(pa.array(text)), anchor, low, high, span, key, whole, np.ones(len(key), np.int64))

    return rows.select("th", "text").mapInArrow(run, ITEM)


def _item_batch(th, anchor, low, high, width, key, whole, n) -> pa.RecordBatch:
    columns = [th, pa.array(anchor), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(np.full(len(key), width, np.int32)), pa.array(key), pa.array(whole), pa.array(n)]
    return pa.RecordBatch.from_arrays(columns, ["th", "anchor", "low", "high", "width", "key", "whole", "n"])


def _texts(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """The text of every row of ``grouped`` (one per th), by a shuffle of these texts alone."""
    texts = maybe(rows, "th", bitmap(grouped.select("th"), "th", grouped.count()))
    return texts.groupBy("th").agg(F.min("text").alias("text")).join(grouped, "th")


def _by_text(items: DataFrame) -> DataFrame:
    """Items of each text in a list, with the number of rows that have it."""
    same = items.groupBy("th", "anchor", "low", "high", "width", "key").agg(F.sum("n").alias("n"))
    return written(same.groupBy("th").agg(F.collect_list(F.struct("anchor", "low", "high", "width", "n")).alias("items")))     # bounded by the text's length


def _halved(rows: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """The items with half as wide a range of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, borders = utf8(text_column(part))
                prefix = prefix_hash(data)
                for k, own in enumerate(part.column("items").to_pylist()):
                    for width in {x["width"] for x in own}:
                        half, split = width // 2, []
                        for x in own:
                            if x["width"] == width:
                                for block in range(x["low"] // half, x["high"] // half + 1):
                                    split.append((x["anchor"], max(x["low"], block * half), min(x["high"], block * half + half - 1), x["n"]))
                        anchor, low, high, n = (np.array(c, np.int64) for c in zip(*split, strict=True))
                        key, whole = keyed(prefix, np.full(len(anchor), borders[k]), anchor, low, high, half, length)
                        th = part.column("th").take(pa.array(np.full(len(anchor), k)))
                        yield _item_batch(th, anchor, low, high, half, key, whole, n)

    return _texts(rows, _by_text(items)).select("th", "text", "items").mapInArrow(run, ITEM)


def _repeated(items: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The items whose core occurs again, and those of them with too many different suffixes."""
    seen = items.groupBy("key", "whole").agg(F.sum("n").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    seen = written(seen.where("n > 1").select("key", "kinds"))             # a table of its own, so that adaptive execution can split a key with many items
    again = maybe(items, "key", bitmap(seen, "key", seen.count())).join(seen, "key")
    columns = ["th", "anchor", "low", "high", "width", "key", "n"]
    return again.where(F.col("kinds") <= most).select(*columns), again.where(F.col("kinds") > most).select(*columns)


def _runs(rows: DataFrame, grouped: DataFrame, buckets: int, length: int) -> DataFrame:
    """Sorted runs (bucket, run), and spans (th, start, stop) of suffixes that a task has more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[tuple, list]] = {}
        for batch in batches:
            for part in slices(batch):
                data, borders = utf8(text_column(part))
                prefix, raw = prefix_hash(data), data.tobytes()
                ths, spans = part.column("th").to_pylist(), []
                for k, own in enumerate(part.column("items").to_pylist()):
                    base = int(borders[k])
                    anchor, low, high, width, n = (np.array([x[c] for x in own], np.int64) for c in ("anchor", "low", "high", "width", "n"))
                    core = base + anchor - low // width * width
                    key = mix(span_hash(prefix, core, core + length + 1 - width) + mix((low // width).astype(np.uint64) + width.astype(np.uint64) * K1))
                    right, left = base + anchor - low + length, base + anchor - high
                    for c, r, s, h, m, lo, hi in zip(core.tolist(), right.tolist(), left.tolist(), key.tolist(), n.tolist(), (low % width).tolist(), (high - low // width * width).tolist(), strict=True):
                        suffix = (h.to_bytes(8) + raw[c:r], raw[s:c], lo, hi)
                        there = found.setdefault(h % buckets, {}).get(suffix)
                        if there is None:
                            found[h % buckets][suffix] = there = [m, ths[k], c - base]
                            if m == 1:
                                continue
                        else:
                            if there[0] == 1:
                                spans.append((there[1], there[2] - hi, there[2] - lo + length))
                            there[0] += m
                        spans.append((ths[k], c - base - hi, c - base - lo + length))
                if spans:
                    yield _out([None] * len(spans), *zip(*spans, strict=True), [None] * len(spans))
        for bucket, suffixes in found.items():
            yield _out([bucket], [None], [None], [None], [_packed(suffixes)])

    return _texts(rows, grouped).select("th", "text", "items").mapInArrow(run, "bucket long, th binary, start long, stop long, run binary")


def _out(bucket, th, start, stop, run) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip((bucket, th, start, stop, run), kinds, strict=True)], ["bucket", "th", "start", "stop", "run"])


def _packed(suffixes: dict[tuple, list]) -> bytes:
    """A front-coded run: header, rows, rests, left contexts."""
    order = sorted(suffixes)
    shared, sizes, rests = front_coded([x[0] for x in order])
    rows = np.zeros(len(order), _ROW)
    rows["shared"], rows["rest"] = shared, sizes
    for k, x in enumerate(order):
        n, th, base = suffixes[x]
        rows[k] = (rows[k]["shared"], rows[k]["rest"], len(x[1]), x[2], x[3], n > 1, th, base)
    return _HEAD.pack(len(order), len(rests)) + rows.tobytes() + rests + b"".join(x[1] for x in order)


def _unpacked(run: bytes) -> tuple[np.ndarray, bytes, bytes]:
    n, size = _HEAD.unpack_from(run)
    at = _HEAD.size + n * _ROW.itemsize
    return np.frombuffer(run, _ROW, n, _HEAD.size), run[at:at + size], run[at + size:]


def repeated_starts(shared: np.ndarray, lefts: list[bytes], low: np.ndarray, high: np.ndarray, several: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each distance before the core, the sorted suffixes (by index) whose window there is repeated.

    ``shared`` has the common prefixes of neighbours, eight bytes of key included; ``lefts`` the bytes before each core.
    """
    cluster = np.cumsum(shared < 8)
    order = sorted(range(len(lefts)), key=lambda i: (cluster[i], lefts[i][::-1]))
    mirrored = [lefts[i][::-1] for i in order]
    back = prefixes(mirrored)
    own = cluster[order]
    back[1:][own[1:] != own[:-1]] = -1
    place = np.array(order, np.int64)
    left_class = np.empty(len(lefts), np.int64)
    for a in range(int(low.min()), int(high.max()) + 1):
        use = np.flatnonzero((low <= a) & (high >= a))
        if len(use) < 2:
            continue
        right_class = np.cumsum(shared < 8 + length - a)
        left_class[place] = np.cumsum(back < a)
        pair = right_class[use] * (len(lefts) + 1) + left_class[use]
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        hit = (count > 1)[inverse] & ~several[use]
        if hit.any():
            yield a, use[hit]


def _merge(length: int):
    def run(table: pa.Table) -> pa.Table:
        runs = [_unpacked(x) for x in table.column("run").to_pylist()]
        lefts_of = [np.concatenate([[0], np.cumsum(rows["left"].astype(np.int64))]) for rows, _, _ in runs]
        at, shared, where = [0] * len(runs), [], []
        for r, _, k in merged([decoded(rows["shared"], rows["rest"], rests) for rows, rests, _ in runs]):
            shared.append(k)
            where.append((r, at[r]))
            at[r] += 1
        shared = np.array(shared, np.int64)
        alone = shared < 8
        alone[:-1] &= shared[1:] < 8
        keep = np.flatnonzero(~alone)
        rows = np.array([runs[r][0][i] for r, i in (where[k] for k in keep)], _ROW) if len(keep) else np.zeros(0, _ROW)
        spans: list[tuple[bytes, int, int]] = []
        if len(keep):
            lefts = [runs[r][2][lefts_of[r][i]:lefts_of[r][i + 1]] for r, i in (where[k] for k in keep)]
            open_: dict[int, list[int]] = {}
            several = rows["several"] > 0
            for a, hit in repeated_starts(shared[keep], lefts, rows["low"].astype(np.int64), rows["high"].astype(np.int64), several, length):
                for i in hit.tolist():
                    known = open_.get(i)
                    if known and known[1] == a - 1:
                        known[1] = a
                    else:
                        if known:
                            spans.append(_span(rows[i], known, length))
                        open_[i] = [a, a]
            spans += [_span(rows[i], known, length) for i, known in open_.items()]
        th, start, stop = zip(*spans, strict=True) if spans else ([], [], [])
        return pa.table([pa.array(th, pa.binary()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["th", "start", "stop"])

    return run


def _span(row, known: list[int], length: int) -> tuple[bytes, int, int]:
    return row["th"].tobytes(), int(row["base"]) - known[1], int(row["base"]) - known[0] + length


def spans(rows: DataFrame, length: int = LENGTH, span: int = SPAN, most: int = MOST, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """Spans (th, start, stop) of repeated bytes, overlapping ones too, of rows with columns th and text."""
    few, many = _repeated(written(_items(rows, length, span)), most)
    found, width = [], span
    few, many = written(few), written(many)
    while not few.isEmpty() or not many.isEmpty():
        if not few.isEmpty():
            buckets = few.count() // bucket_items + 1
            sent = written(_runs(rows, _by_text(few), buckets, length))
            found.append(sent.where("th IS NOT NULL").select("th", "start", "stop"))
            found.append(written(sent.where("run IS NOT NULL").select("bucket", "run").groupBy("bucket").applyInArrow(_merge(length), "th binary, start long, stop long")))
        if many.isEmpty() or width == 1:
            break
        width //= 2
        few, many = map(written, _repeated(written(_halved(rows, many, length)), most if width > 1 else 1 << 62))
    out = rows.sparkSession.createDataFrame([], "th binary, start long, stop long")
    for part in found:
        out = out.unionByName(part)
    return out


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", digest())
    found = spans(rows.select("th", "text"), length, **settings)
    by_text = written(found.groupBy("th").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))        # bounded by the text's length
    marks = bitmap(by_text.select("th"), "th", by_text.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, own in zip(text_column(part).to_pylist(), part.column("spans").to_pylist(), strict=True):
                    raw, pieces, at, removed, n = text.encode(), [], 0, 0, 0
                    for x in sorted((s["start"], s["stop"]) for s in own or ()):
                        if x[1] <= at:
                            continue
                        if x[0] > at or not n:
                            pieces.append(raw[at:x[0]])
                            n += 1
                            removed += x[1] - x[0]
                        else:
                            removed += x[1] - at
                        at = x[1]
                    out.append((len(raw), removed, n, b"".join([*pieces, raw[at:]])))
                a, b, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    cut = maybe(rows, "th", marks).join(by_text, "th", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    whole = absent(rows, "th", marks).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                                             F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(whole)
