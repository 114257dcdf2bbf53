"""Vectors that are kept: per model a folder of batches, each of which appears by one rename and is never changed.

A refresh computes only texts without a vector and adds them as the next batch. If another job was first, the
draft loses what that job added and tries the next number, so a digest is in one batch only and readers need no
deduplication. A job that dies leaves a draft that no reader sees.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailquarry.operators import embedding
from mailquarry.plans import registry


def stored(spark: SparkSession, root: str, model: str, upto: int | None = None) -> DataFrame:
    """``text_hash, embedding`` of all batches, or of those up to a number."""
    numbers = [n for n in registry.versions(spark, root, model) if upto is None or n <= upto]
    if not numbers:
        return spark.createDataFrame([], embedding.VECTORS)
    return spark.read.schema(embedding.VECTORS).parquet(*[f"{root}/{model}/v{n}" for n in numbers])


def refresh(docs: DataFrame, text: str, root: str, model: str, make_model: Callable[[], embedding.Model], **settings) -> int:
    """Computes the vectors that are missing for these texts and stores them; returns how many are new."""
    spark = docs.sparkSession
    known = max(registry.versions(spark, root, model), default=0)
    draft = f"{root}/{model}/_{uuid.uuid4().hex}"
    fresh = embedding.fresh_vectors(docs, text, make_model, stored(spark, root, model, known) if known else None, **settings)
    fresh.write.parquet(draft)
    while True:
        new = spark.read.schema(embedding.VECTORS).parquet(draft)
        count = new.count()
        if count == 0 or registry.appeared(spark, draft, root, model, known + 1):
            return count
        latest = max(registry.versions(spark, root, model))
        narrower = f"{root}/{model}/_{uuid.uuid4().hex}"
        new.join(stored(spark, root, model, latest).select("text_hash"), "text_hash", "left_anti").write.parquet(narrower)
        draft, known = narrower, latest
