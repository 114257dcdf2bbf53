"""Token ids in files: every document is a zstandard frame of its own, all with one shared dictionary.

A dataset is a Parquet table ``blocks`` in document order and a table ``dictionary`` with one row. A block is a byte
string: a header (magic, width of an id, number of documents, SHA-256 of the dictionary), the offset index (id, null
flag, token count and place of each document) and the frames. A document is read by its block's id range and its
entry in the index, without a look at any other frame.

The order is ascending by id, nulls first, and ties by a hash of the text; repeated rows are written once for each row.
Nulls and empty texts have the end id alone. An empty table gives a dataset without blocks. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquarry.llm.arrays import slices, text_column
from mailquarry.llm.tokens import encoder

MAGIC = b"MQT1"
HEADER = struct.Struct("<4sHHI32s")
BLOCK_BYTES = 1 << 20
BLOCKS = "shard int, block int, before long, n_docs int, n_tokens long, min_id long, max_id long, payload binary"
DOCUMENTS = "shard int, at long, doc_id long, n_tokens long, ids binary"
SAMPLE_DOCS = 400               # documents that the dictionary is trained on, about,
SAMPLE_DOC_BYTES = 16_384       # each no longer than this
DICTIONARY_BYTES = 32_768
BROADCAST_SHARDS = 65_536       # 16 bytes each
LEVEL = 3


def serialized(ids: np.ndarray) -> tuple[int, bytes]:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return width, ids.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """Dictionary from a bounded sample of documents, chosen by a hash; empty if they are too few to train one."""
    short = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_DOC_BYTES)
    draw = F.pmod(F.xxhash64(F.lit("dictionary"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    texts = sorted(r.text for r in short.where(draw * F.lit(float(docs.count())) < SAMPLE_DOCS).limit(4 * SAMPLE_DOCS).collect())
    if not texts:
        return b""
    ids, borders = encoder(tokenizer).encode(texts)
    frames = [serialized(ids[a:b])[1] for a, b in zip(borders[:-1], borders[1:], strict=True)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, frames)) // 4), frames).as_bytes()
    except zstandard.ZstdError:
        return b""


class Block:
    """Frames of successive documents, and the bytes they make."""

    def __init__(self, dictionary: bytes) -> None:
        self.hash = hashlib.sha256(dictionary).digest()
        self.writer = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.frames, self.ids, self.counts, self.size = [], [], [], 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        width, raw = serialized(ids)
        frame = bytes([width]) + self.writer.compress(raw)
        self.frames.append(frame)
        self.ids.append(doc)
        self.counts.append(len(ids))
        self.size += len(frame)

    def payload(self) -> bytes:
        ends = np.cumsum([0, *map(len, self.frames)]).astype("<u8")
        index = [np.array([i or 0 for i in self.ids], "<i8"), np.array([i is None for i in self.ids], "u1"), np.array(self.counts, "<u8"), ends]
        return HEADER.pack(MAGIC, 1, 0, len(self.ids), self.hash) + b"".join(x.tobytes() for x in index) + b"".join(self.frames)


class BlockReader:
    """A block's index, and its documents on demand."""

    def __init__(self, payload: bytes, dictionary: bytes) -> None:
        magic, _, _, n, digest = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at = HEADER.size
        self.doc_ids = np.frombuffer(payload, "<i8", n, at)
        self.nulls = np.frombuffer(payload, "u1", n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(payload, "<u8", n, at + 9 * n).astype(np.int64)
        self.places = np.frombuffer(payload, "<u8", n + 1, at + 17 * n).astype(np.int64)
        self.data, self.begin = memoryview(payload), at + 17 * n + 8 * (n + 1)
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        frame = self.data[self.begin + self.places[k]:self.begin + self.places[k + 1]]
        return np.frombuffer(self.reader.decompress(bytes(frame[1:])), f"<u{frame[0]}").astype(np.uint32)


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the dataset. Ranges of ids go to tasks, each task writes its documents in order."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(docs, tokenizer)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before, block = TaskContext.get().partitionId(), 0, 0, Block(dictionary)

        def full() -> pa.RecordBatch:
            nonlocal number, before, block
            known = [i for i in block.ids if i is not None]
            row = (shard, number, before, len(block.ids), sum(block.counts), min(known, default=None), max(known, default=None), block.payload())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            number, before, block = number + 1, before + sum(block.counts), Block(dictionary)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for part in slices(batch):
                ids, borders = encoder(tokenizer).encode(text_column(part).to_pylist())
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    block.add(doc, ids[borders[k]:borders[k + 1]])
                    if block.size >= BLOCK_BYTES:
                        yield full()
        if block.ids:
            yield full()

    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def dictionary_of(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()[0])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the dataset: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits)."""
    dictionary = dictionary_of(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "before", "payload")), strict=True):
                block = BlockReader(payload, dictionary)
                n = len(block.counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array(before + np.cumsum(block.counts) - block.counts, pa.int64()),
                     pa.array(block.doc_ids, pa.int64(), mask=block.nulls), pa.array(block.counts, pa.int64()),
                     pa.array([block.ids(k).astype("<u4").tobytes() for k in range(n)], pa.binary())], ["shard", "at", "doc_id", "n_tokens", "ids"])

    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))     # one row per task that wrote
    base = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    if totals.count() <= BROADCAST_SHARDS:
        base = F.broadcast(base)
    rows = blocks.select("shard", "before", "payload").mapInArrow(run, DOCUMENTS)
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Ids of all documents with this id; only the blocks of its range are read, and only their frames of this id."""
    dictionary = dictionary_of(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id))
    found = []
    for row in blocks.select("payload").toLocalIterator():
        block = BlockReader(bytes(row.payload), dictionary)
        found += [block.ids(int(k)) for k in np.flatnonzero((block.doc_ids == doc_id) & ~block.nulls)]
    return found
