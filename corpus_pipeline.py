"""The pipeline over ``documents``: stages that each take what the one before has kept.

All but the last return the columns of ``documents``, and rows with nulls, empty texts or repeated ids pass by the rules
that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailquarry.llm import decontaminate, exact, langid, neardup, packing
from mailquarry.llm.arrays import small_batches
from mailquarry.llm.queries import TOKENIZER, table
from mailquarry.plans.staging import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter or without a clear winner go."""
    return langid.known(docs, langid.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of token ids."""
    return packing.pack(docs, TOKENIZER)


def bounded(stage):
    """The stage in a session whose Arrow batches are limited by bytes; Python workers live on from stage to stage, and so does their memory."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, bounded(stage)) for name, stage in (("language ID", language), ("exact dedup", exact_dedup), ("near-duplicates", near_dedup),
                                                     ("decontamination", decontaminated), ("packing", packed))]
ORACLE_SQL = None           # language models, edit distance and tokenizers have no SQL form; tests hold every stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
