"""Readers for labelled mail corpora. Each returns ``label, raw_email, source``.

A missing file, or a file without usable columns, gives an empty frame with this schema.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.functions import text as X
from mailquarry.operators import clean, corpus


def empty_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], corpus.CORPUS_SCHEMA)


def _first_existing(read, paths: Iterable[str]) -> DataFrame | None:
    for p in paths:
        try:
            return read(p)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    return None


def csv_corpus(spark: SparkSession, paths: Sequence[str], source: str, encoding: str = "UTF-8", **to_corpus) -> DataFrame:
    """First existing CSV of ``paths`` (file, folder or glob). Quoted line breaks are allowed.

    Such a file cannot be split, so a large corpus should come as many files or be rewritten as Parquet.
    """
    def read(p: str) -> DataFrame:
        return spark.read.csv(p, header=True, multiLine=True, quote='"', escape='"', encoding=encoding)

    df = _first_existing(read, paths)
    out = clean.to_corpus(df, source, **to_corpus) if df is not None else None
    return empty_corpus(spark) if out is None else out


def parquet_corpus(spark: SparkSession, paths: Sequence[str], source: str, **to_corpus) -> DataFrame:
    """Columnar corpora, with or without a label column."""
    df = _first_existing(spark.read.parquet, paths)
    out = clean.to_corpus(df, source, **to_corpus) if df is not None else None
    return empty_corpus(spark) if out is None else out


def blob_corpus(spark: SparkSession, paths: Sequence[str], source: str, label: int = 1, min_chars: int = 50) -> DataFrame:
    """A text file of mails separated by blank lines; the file is split at the separator while reading."""
    def read(p: str) -> DataFrame:
        return spark.read.text(p, lineSep="\n\n")

    df = _first_existing(read, paths)
    if df is None:
        return empty_corpus(spark)
    return blob_chunks(df, "value", min_chars).select(
        F.lit(label).alias("label"), F.col("chunk").alias("raw_email"), F.lit(source).alias("source"))


def blob_chunks(df: DataFrame, text: str, min_chars: int = 50) -> DataFrame:
    """Split texts at blank lines, trim, keep chunks of at least ``min_chars`` characters."""
    keep = [c for c in df.columns if c != text]
    chunks = df.select(*keep, F.posexplode(F.split(F.col(text), "\n\n")).alias("chunk_no", "chunk"))
    return (chunks.withColumn("chunk", X.strip(F.col("chunk")))
            .where(F.length("chunk") >= min_chars))


def mail_folder(spark: SparkSession, path: str, label: int, source: str, min_chars: int = 0, recursive: bool = True) -> DataFrame:
    """A folder with one raw mail per file; bad bytes become U+FFFD."""
    def read(p: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(p)

    df = _first_existing(read, [path])
    if df is None:
        return empty_corpus(spark)
    out = df.select(F.lit(label).alias("label"),
                    F.make_valid_utf8(F.col("content").cast("string")).alias("raw_email"),
                    F.lit(source).alias("source"))
    return clean.min_length(clean.drop_blank(out), min_chars)


def mbox(spark: SparkSession, path: str, label: int, source: str) -> DataFrame:
    """Mails of an mbox file, cut at the separator lines while reading.

    The separator needs a line break in front of it, so the first mail keeps its own ``From `` line,
    which is removed like the rest of the separator line of the others.
    """
    def read(p: str) -> DataFrame:
        return spark.read.text(p, lineSep="\nFrom ")

    df = _first_existing(read, [path])
    if df is None:
        return empty_corpus(spark)
    body = F.regexp_replace(F.col("value"), "^[^\n]*\n", "")
    out = df.select(F.lit(label).alias("label"), body.alias("raw_email"),
                    F.lit(source).alias("source"))
    return clean.drop_blank(out)


def ham_and_spam(spark: SparkSession, ham_dirs: Sequence[str], spam_dirs: Sequence[str], source: str,
                 ham_mbox: str | None = None, spam_mbox: str | None = None) -> DataFrame:
    """Folders and mbox files with a fixed label each."""
    frames = [mail_folder(spark, p, 0, source) for p in ham_dirs]
    frames += [mail_folder(spark, p, 1, source) for p in spam_dirs]
    frames += [mbox(spark, p, y, source) for p, y in ((ham_mbox, 0), (spam_mbox, 1)) if p]
    return corpus.union_corpora(*frames)


def prepared_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A corpus written earlier; ``source`` defaults to 'processed'."""
    reader = spark.read if fmt == "parquet" else spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    df = reader.format(fmt).load(path)
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit("processed"))
    return df.select(F.col("label").cast("int").alias("label"), F.col("raw_email").cast("string").alias("raw_email"), "source")


def popularity_list(spark: SparkSession, path: str) -> DataFrame:
    """Rank and domain of a popularity list (CSV without header)."""
    return spark.read.csv(path, schema="rank INT, domain STRING").withColumn("domain", F.lower("domain"))


def not_in_allowlist(df: DataFrame, domains: DataFrame, column: str = "domain") -> DataFrame:
    """Rows whose domain is not on the list."""
    return df.join(domains.select(F.col("domain").alias(column)).distinct(), column, "left_anti")
