"""Sparse feature vectors over an ordered vocabulary.

The vocabulary is a small table ``term, pos, tf, df, idf`` of a stated size, published and loaded by version
(:mod:`mailquarry.plans.registry`). Its terms are counted inside the row of a text, in the JVM, through a broadcast hash map;
nothing is exploded or shuffled, and no array as wide as the vocabulary is built. Terms outside it are counted, not kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry import lists as L
from mailquarry.operators import clean
from mailquarry.operators.text import doc_terms, tfidf_vocabulary

MAX_TERMS = 100_000         # what is broadcast ends here


def ordered_vocabulary(docs: DataFrame, doc_id: str, text: str, size: int = L.TFIDF_TERMS, min_df: int = 2) -> DataFrame:
    """``term, pos, tf, df, idf``: the vocabulary of a corpus in the order of its terms, positions from 0."""
    found = tfidf_vocabulary(docs, doc_id, text, size, min_df)
    return found.withColumn("pos", F.row_number().over(Window.orderBy("term")) - 1)          # at most ``size`` rows


def _entries(vocabulary: DataFrame) -> list:
    found = vocabulary.select("pos", "term", "idf").orderBy("pos").limit(MAX_TERMS + 1).collect()
    if len(found) > MAX_TERMS:
        raise ValueError(f"a vocabulary has at most {MAX_TERMS} terms")
    if [r.pos for r in found] != list(range(len(found))):
        raise ValueError("the positions of a vocabulary are 0, 1, 2, ...")
    return found


def tfidf_rows(docs: DataFrame, doc_id: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """``doc_id, tfidf, n_terms, n_unseen``: weights (1 + ln tf) * idf with unit length as ``indices, values``.

    Every document has a row. One that is NULL, empty or without known terms has empty arrays; ``n_unseen``
    counts its words and pairs outside the vocabulary, repeats included.
    """
    entries = _entries(vocabulary)
    terms = doc_terms(docs, doc_id, text).select("doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    if not entries:
        none = F.struct(F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values"))
        return terms.select("doc_id", none.alias("tfidf"), F.size("terms").alias("n_terms"), F.size("terms").alias("n_unseen"))
    counter = CountVectorizerModel.from_vocabulary([r.term for r in entries], inputCol="terms", outputCol="_vector")
    counted = counter.transform(terms).select("doc_id", F.size("terms").alias("n_terms"), F.unwrap_udt("_vector").alias("_c"))
    idf = F.array(*[F.lit(r.idf) for r in entries])
    raw = F.zip_with("_c.indices", "_c.values", lambda i, n: (1 + F.log(n)) * F.get(idf, i))
    total = F.aggregate("_c.values", F.lit(0.0), lambda a, n: a + n).cast("int")
    weighed = counted.select("doc_id", "n_terms", (F.col("n_terms") - total).alias("n_unseen"), F.col("_c.indices").alias("_i"), raw.alias("_w"))
    weighed = weighed.withColumn("_norm", F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, w: a + w * w)))
    unit = F.transform("_w", lambda w: w / F.col("_norm"))
    return weighed.select("doc_id", F.struct(F.col("_i").alias("indices"), unit.alias("values")).alias("tfidf"), "n_terms", "n_unseen")


def feature_rows(table: DataFrame, names: Sequence[str], embedding: str | None = None, embedding_dim: int = L.EMBEDDING_DIM,
                 tfidf: str | None = None, n_terms: int = 0) -> DataFrame:
    """Adds ``features``: the named columns, the dense vector and the TF-IDF weights, in this order, as a sparse vector in parts.

    Positions are ``names``, then ``embedding_dim`` components, then ``n_terms`` terms. Values that are NULL or not
    finite are 0, and zeros are not stored. :func:`as_vectors` makes ML vectors of the parts.
    """
    dense: Column = F.array(*[clean.zero_if_not_finite(F.col(f"`{n}`")) for n in names]) if names else F.array().cast("array<double>")
    if embedding is not None:
        part = F.transform(F.slice(F.col(embedding), 1, embedding_dim), clean.zero_if_not_finite)
        dense = F.concat(dense, F.coalesce(part, F.array().cast("array<double>")))
    start = len(names) + (embedding_dim if embedding is not None else 0)
    kept = F.filter(F.transform(dense, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: p["v"] != 0)
    others = [c for c in table.columns if c not in ("features", tfidf)]
    staged = table.select(*others, *([F.col(tfidf).alias("_tfidf")] if tfidf else []), kept.alias("_kept"))
    indices, values = F.transform("_kept", lambda p: p["i"]), F.transform("_kept", lambda p: p["v"])
    if tfidf is not None:
        indices = F.concat(indices, F.coalesce(F.transform("_tfidf.indices", lambda i: i + start), F.array().cast("array<int>")))
        values = F.concat(values, F.coalesce("_tfidf.values", F.array().cast("array<double>")))
    whole = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(start + (n_terms if tfidf is not None else 0)).alias("size"),
                     indices.alias("indices"), values.alias("values"))
    return staged.select(*others, whole.alias("features"))


def as_vectors(parts: DataFrame, path: str, features: str = "features") -> DataFrame:
    """The table with ML vectors, written to ``path`` and read back: training reads it once per pass anyway."""
    parts.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name == features else f.dataType) for f in parts.schema])
    return parts.sparkSession.read.schema(schema).parquet(path)


def vector_entries(df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
    """``keep..., index, value``: the stored entries of a column of sparse vectors."""
    v = F.unwrap_udt(features)
    return df.select(*keep, F.inline(F.arrays_zip(v["indices"].alias("index"), v["values"].alias("value"))))
