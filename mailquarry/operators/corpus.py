"""Corpus curation: union, near-duplicate removal, sampling, splitting and balance reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry import lists as L
from mailquarry.functions import text as X
from mailquarry.operators.ranking import hash_cuts, order_hash

CORPUS_SCHEMA = T.StructType([
    T.StructField("label", T.IntegerType()),
    T.StructField("raw_email", T.StringType()),
    T.StructField("source", T.StringType()),
])


def union_corpora(*frames: DataFrame | None) -> DataFrame:
    """Union by name; missing corpora (None) are skipped."""
    present = [f for f in frames if f is not None]
    if not present:
        raise ValueError("no corpus to combine")
    return reduce(lambda a, b: a.unionByName(b), present)


def add_mail_id(df: DataFrame) -> DataFrame:
    """Surrogate key from the content, equal on every run and after a task retry.

    Rows that agree in source, label and text get the same key; they are exact copies, so drop them
    first (``dropDuplicates``) when the key has to be unique.
    """
    return df.withColumn("mail_id", F.xxhash64("source", "label", "raw_email"))


def source_priority(source: Column, priority: dict[str, int] | None = None,
                    default: int = L.DEFAULT_SOURCE_PRIORITY) -> Column:
    """Preference of a corpus (lower wins). The table has a fixed handful of rows, so it is a CASE."""
    out = F.lit(default)
    for name, value in (L.SOURCE_PRIORITY if priority is None else priority).items():
        out = F.when(source == name, F.lit(value)).otherwise(out)
    return out


def dedup_key(text: Column, prefix: int | None = None) -> Column:
    """Key of equal texts: SHA-256 of the trimmed text in lower case, or its start when a ``prefix`` length is given."""
    if prefix is None:
        return F.sha2(F.lower(X.strip(text)), 256)
    return F.lower(F.substring(X.strip(text), 1, prefix))


def _keepers(df: DataFrame, priority: dict[str, int] | None, prefix: int | None) -> DataFrame:
    # Priority and id in one decimal, so the minimum stays a plain hash aggregate that is combined
    # before the shuffle: a key shared by a third of the table costs one row per task.
    rank = (source_priority(F.col("source"), priority).cast("decimal(4,0)") * F.lit("20000000000000000000").cast("decimal(20,0)")
            + F.col("mail_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(19,0)"))
    best = (df.select(dedup_key(F.col("raw_email"), prefix).alias("_key"), rank.cast("decimal(25,0)").alias("_rank"))
            .groupBy("_key").agg(F.min("_rank").alias("_rank")))
    mail_id = F.pmod("_rank", F.lit("20000000000000000000").cast("decimal(20,0)")) - F.lit("9223372036854775808").cast("decimal(19,0)")
    return best.select("_key", mail_id.cast("bigint").alias("mail_id"))


def drop_near_duplicates(df: DataFrame, priority: dict[str, int] | None = None, prefix: int | None = None) -> DataFrame:
    """Keep one row per key (see ``dedup_key``): best source first, then the smallest ``mail_id``.

    The texts themselves are shuffled at most once (for the semi join on key and id), and no key group is
    ever gathered in one task. Two mails with one id are told apart by their keys.
    """
    keyed = df.withColumn("_key", dedup_key(F.col("raw_email"), prefix))
    return keyed.join(_keepers(df, priority, prefix), ["_key", "mail_id"], "left_semi").select(*df.columns)


def dedup_report(df: DataFrame, priority: dict[str, int] | None = None, prefix: int | None = None) -> DataFrame:
    """Rows, kept rows and removed rows per source."""
    kept = _keepers(df, priority, prefix).withColumn("_kept", F.lit(1))
    return (df.select("mail_id", "source", dedup_key(F.col("raw_email"), prefix).alias("_key")).join(kept, ["_key", "mail_id"], "left")
            .groupBy("source")
            .agg(F.count("*").alias("total"), F.count("_kept").alias("kept"))
            .withColumn("removed", F.col("total") - F.col("kept")))


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """Reproducible global order (a range-partitioned sort; only needed for ordered export)."""
    return df.orderBy(order_hash(F.col("mail_id"), seed), "mail_id")


def sample_exactly(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same ones on every run.

    The n-th smallest hash is found on ids alone; the rows are then filtered where they are.
    """
    h = order_hash(F.col("mail_id"), seed)
    ids = df.select(F.lit(0).alias("g"), h.alias("h"))
    total = ids.groupBy("g").agg(F.count("*").alias("n"))
    wanted = total.select("g", F.lit(0).alias("target"), F.least(F.col("n"), F.lit(n)).alias("rank"))
    cut = hash_cuts(ids, ["g"], wanted).select("cut")
    return (df.withColumn("_g", F.lit(0)).withColumn("_h", h)
            .join(F.broadcast(cut.select(F.lit(0).alias("_g"), "cut")), "_g")
            .where(F.col("_h") <= F.col("cut")).drop("_g", "_h", "cut"))


def stratified_split(df: DataFrame, test_share: float = 0.2, seed: int = 42, label: str = "label") -> DataFrame:
    """Add ``split``: the first ceil(share * n) rows of each label in hash order are the test part.

    One narrow pass over ids finds one cut per label; the wide rows are labelled without a shuffle.
    """
    h = order_hash(F.col("mail_id"), seed)
    ids = df.select(label, h.alias("h"))
    wanted = (ids.groupBy(label).agg(F.count("*").alias("n"))
              .select(label, F.lit(0).alias("target"), F.ceil(F.col("n") * F.lit(test_share)).alias("rank")))
    cuts = hash_cuts(ids, [label], wanted).select(label, "cut")
    return (df.withColumn("_h", h).join(F.broadcast(cuts), label)
            .withColumn("split", F.when(F.col("_h") <= F.col("cut"), F.lit("test")).otherwise(F.lit("train")))
            .drop("_h", "cut"))


def assign_folds(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label", id_col: str = "mail_id") -> DataFrame:
    """Add ``fold`` in 0..k-1; every label is spread evenly (sizes differ by at most one row)."""
    h = order_hash(F.col(id_col), seed)
    ids = df.select(label, h.alias("h"))
    wanted = (ids.groupBy(label).agg(F.count("*").alias("n"))
              .select(label, "n", F.explode(F.sequence(F.lit(0), F.lit(k - 2))).alias("target"))
              .select(label, "target", F.ceil((F.col("target") + 1) * F.col("n") / F.lit(k)).alias("rank"))
              .where("rank > 0"))
    cuts = (hash_cuts(ids, [label], wanted).groupBy(label)
            .agg(F.array_sort(F.collect_list("cut")).alias("_cuts")))      # at most k-1 values per label
    fold = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<string>")), lambda c: c < F.col("_h")))
    return (df.withColumn("_h", h).join(F.broadcast(cuts), label, "left")
            .withColumn("fold", fold).drop("_h", "_cuts"))


def class_balance(df: DataFrame) -> DataFrame:
    """Counts per source and, with source 'ALL', in total; ratio = phishing / max(legitimate, 1)."""
    return (df.rollup("source")
            .agg(F.count("*").alias("total"),
                 F.coalesce(F.sum((F.col("label") == 1).cast("bigint")), F.lit(0)).alias("phishing"),
                 F.coalesce(F.sum((F.col("label") == 0).cast("bigint")), F.lit(0)).alias("legitimate"),
                 F.grouping("source").alias("_all"))
            .select(F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("source")).alias("source"),
                    "total", "phishing", "legitimate",
                    F.round(F.col("phishing") / F.greatest(F.col("legitimate"), F.lit(1)), 6).alias("imbalance_ratio")))


def two_class_guard(df: DataFrame) -> DataFrame:
    """One row: number of distinct labels and whether both classes are present."""
    return df.agg(F.countDistinct("label").alias("n_labels")).withColumn("ok", F.col("n_labels") >= 2)


def raw_fingerprint(df: DataFrame) -> DataFrame:
    """Exact copies: per SHA-256 of the raw mail the number of copies and the first id."""
    return (df.select("mail_id", F.sha2(F.col("raw_email"), 256).alias("sha256"))
            .groupBy("sha256").agg(F.count("*").alias("copies"), F.min("mail_id").alias("first_id")))


def corpus_manifest(df: DataFrame) -> DataFrame:
    """Counts per split and source, to be written as the data set manifest."""
    return df.groupBy("split", "source").agg(
        F.count("*").alias("total"),
        F.sum((F.col("label") == 1).cast("bigint")).alias("phishing"),
        F.sum((F.col("label") == 0).cast("bigint")).alias("legitimate"))


def class_weights(df: DataFrame, label: str = "label", digits: int | None = 6) -> DataFrame:
    """Balanced weight n / (classes * n_class) per label, a table with one row per class; rounded for reports only."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    weight = F.col("_n") / (F.col("_k") * F.col("n"))
    return counts.join(F.broadcast(total)).select(label, "n", (weight if digits is None else F.round(weight, digits)).alias("weight"))
