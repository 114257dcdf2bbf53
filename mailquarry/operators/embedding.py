"""Dense vectors of texts, by the content of the text.

A text is known by the digest of its first words, so equal texts are computed once, whatever mail they come from. Models run in
Python workers, batch by batch; where the vectors are kept is the matter of :mod:`mailquarry.plans.vectors`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry import lists as L
from mailquarry.functions import rows
from mailquarry.functions import text as X
from mailquarry.operators.reputation import lookup_join
from mailquarry.operators.text import truncate_words

Model = Callable[[np.ndarray], np.ndarray]
VECTORS = "text_hash string, embedding array<float>"


def model_text(text: Column, words: int = L.EMBEDDING_WORDS) -> Column:
    """What a model sees of a text: its first ``words`` words; NULL is empty."""
    return truncate_words(F.coalesce(text, F.lit("")), words)


def fresh_vectors(docs: DataFrame, text: str, make_model: Callable[[], Model], known: DataFrame | None = None, words: int = L.EMBEDDING_WORDS,
                  batch_size: int = 256) -> DataFrame:
    """``text_hash, embedding`` of every distinct text that has words and is not in ``known(text_hash)``.

    ``make_model`` is called once per Python worker and returns a function from a batch of strings to rows of
    an array. Repeats are combined before the shuffle, and only texts without a vector reach the workers.
    """
    from pyspark.ml.functions import predict_batch_udf

    short = rows.with_fixed(docs.select(F.col(text).alias("_all")), "_text", model_text(F.col("_all"), words)).where(X.strip(F.col("_text")) != "")
    texts = short.groupBy(F.sha2("_text", 256).alias("text_hash")).agg(F.any_value("_text").alias("_text"))
    if known is not None:
        texts = texts.join(known.select("text_hash"), "text_hash", "left_anti")
    run = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return texts.select("text_hash", run("_text").alias("embedding"))


def with_vectors(docs: DataFrame, text: str, vectors: DataFrame, dim: int, id_col: str = "mail_id", words: int = L.EMBEDDING_WORDS) -> DataFrame:
    """``id, embedding`` of every row by the digest of its text; rows without words or without a vector get zeros.

    Only ids and digests meet the vectors; a text shared by many rows is spread by ``id``.
    """
    keys = docs.select(id_col, F.sha2(model_text(F.col(text), words), 256).alias("text_hash"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return lookup_join(keys, vectors, "text_hash", spread=id_col).select(id_col, F.coalesce("embedding", zeros).alias("embedding"))


# --- a model without weights --------------------------------------------------------------

PROJECTION_DIM = 32


@lru_cache(maxsize=100_000)
def _signs(word: str) -> bytes:
    return bytes(2 * int(c, 16) for c in hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest())


def digest_projection() -> Model:
    """Sum over the words of the 32 hex digits of their MD5, each digit ``d`` taken as ``2 d - 15``: whole numbers that SQL can repeat.

    It stands where a learned model goes; near texts have near directions.
    """
    word = re.compile(f"[^{re.escape(X.BLANKS)}]+")

    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), PROJECTION_DIM), np.float32)
        for row, text in enumerate(texts):
            found = word.findall(text)
            if found:
                digits = np.frombuffer(b"".join(map(_signs, found)), np.uint8).reshape(len(found), PROJECTION_DIM)
                out[row] = digits.sum(axis=0, dtype=np.int64) - 15 * len(found)
        return out

    return predict
