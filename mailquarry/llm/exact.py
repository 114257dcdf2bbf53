"""Exact deduplication by stateful streaming.

The rows' digests pass through a streaming aggregation whose keyed state is kept on disk (RocksDB) and never expires.
The state of a digest is the number of its rows and the row that stays: its id and its locator (file and row), so a text
is never held. On a hit, that is for every digest seen more than once, the full bytes are compared: the texts of
these digests alone are read again, and a group whose smallest and largest text differ is split by its texts.

Texts are equal when identical after lower-casing A-Z. The row with the largest id stays; among equal ids (repeated
rows) the one with the largest locator. Null and empty texts are equal. A null id loses to every other one. An empty
table gives no rows. Other columns are ignored.

Everything is a DataFrame operation. A group is never gathered: its rows meet in aggregates that are combined in the
tasks first, and the join back to the rows is one to many, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.llm.bitmap import absent, bitmap, maybe
from mailquarry.plans.staging import scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}          # no preallocated files in each partition's store
FILES_PER_BATCH = 1000


def normalized(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and locator of every row. A frame that isn't read from files is written first."""
    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator")
    try:
        return docs.select(*own, place)
    except AnalysisException:
        return written(docs.select(*own)).select("doc_id", "text", place)


def _stream(spark: SparkSession, feed: str, schema, checkpoint: str) -> DataFrame:
    """Runs the feed through the state and returns the state."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(feed)
        state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("stay"))
        state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        found = spark.read.format("statestore").load(checkpoint)
        count, stay = (f.name for f in found.schema["value"].dataType.fields)
        return written(found.select("key.digest", F.col(f"value.{count}").alias("n"), F.col(f"value.{stay}").alias("stay")))
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _verified(rows: DataFrame, groups: DataFrame) -> DataFrame | None:
    """Groups with different texts under one digest, split by text; None if there are none."""
    hits = groups.where("n > 1").select("digest")
    n_hits = hits.count()
    if not n_hits:
        return None
    again = maybe(rows.select("digest", "norm", "doc_id", "locator"), "digest", bitmap(hits, "digest", n_hits))
    mixed = written(again.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most").select("digest"))
    if mixed.isEmpty():
        return None
    return again.join(mixed, "digest").groupBy("digest", "norm").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("stay"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), locator.

    ``digest`` replaces SHA-256 as the key of the state (a function of the column ``norm``), e.g. by a shorter one.
    """
    spark = docs.sparkSession
    rows = located(docs, id_col, text_col).withColumn("norm", normalized())
    rows = rows.withColumn("sha", F.sha2(F.col("norm"), 256)).withColumn("digest", F.unhex("sha") if digest is None else digest)
    folder = scratch(spark)
    rows.select("doc_id", "digest", "sha", "locator").write.parquet(f"{folder}/feed")
    feed = spark.read.parquet(f"{folder}/feed")
    groups = _stream(spark, f"{folder}/feed", feed.schema, f"{folder}/state")
    split = _verified(rows, groups)
    if split is None:
        found = feed.join(groups, "digest")
    else:
        split = written(split.withColumn("sha", F.sha2(F.col("norm"), 256)).drop("norm"))
        # texts under one short digest are told apart by their SHA-256 from here on
        whole = groups.join(split.select("digest").distinct(), "digest", "left_anti")
        found = feed.join(whole, "digest").unionByName(feed.join(split, ["digest", "sha"]))
    stays = F.col("stay.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stay.locator") == F.col("locator"))
    return found.select("doc_id", F.col("stay.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.col("sha").alias("text_sha256"), "locator")


def without(docs: DataFrame, dropped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without the rows whose locators ``dropped`` returns, with all columns. Only rows that may go are shuffled."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_locator")
    try:
        rows = docs.select("*", place)
    except AnalysisException:
        docs = written(docs)
        rows = docs.select("*", place)
    gone = written(dropped(docs).select(F.col("locator").alias("_locator")))
    n_gone = gone.count()
    if not n_gone:
        return docs
    marks = bitmap(gone, "_locator", n_gone)
    suspects = maybe(rows, "_locator", marks).join(gone, "_locator", "left_anti")
    return absent(rows, "_locator", marks).unionByName(suspects).drop("_locator")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return without(docs, lambda source: dedup(source, id_col, text_col).where("NOT kept"))
