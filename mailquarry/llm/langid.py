"""Language identification by prediction by partial matching over bytes.

For every language a tree of byte contexts up to order three is counted. A byte is coded in the longest context that
the tree has; bytes not seen there are reached by an escape (method C: as likely as the context has distinct bytes) to
the next shorter context, with the bytes of the longer one excluded, down to a uniform distribution. The statistics are
frozen after training, so every context and byte has one exact code length per language and the trees become one
table. A text gets the language with the shortest code; the score is its share of the likelihood under equal priors.

Letters are coded in lower case (ASCII and the Latin letters of two bytes that start with C3); all other ASCII bytes
are one symbol. The trees are fitted on a bounded sample of ``TRAIN_DOCS`` documents per language, chosen by a hash.

Null texts and texts without a letter are ``und`` with score 0, as is every text if there is nothing to learn from.
Rows without a language are not learned from. Equal code lengths go to the first language by name. Repeated rows get
equal answers, other columns are ignored, texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.arrays import forget, lowered, slices, text_column, utf8

if TYPE_CHECKING:           # not in the workers, where pandas takes over 20 MB
    import pandas as pd

TRAIN_DOCS = 4000           # documents per language, about
MIN_CONTEXT = 8             # occurrences of a context of order three
SLICE = 1 << 17             # bytes of text that are judged at once
LEAST_SCORE = 0.5           # below, a text has no language in :func:`known`
UND = "und"
PREDICTED = "doc_id long, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")
_SYMBOL = np.where((np.arange(256) >= 128) | ((np.arange(256) >= 97) & (np.arange(256) <= 122)), np.arange(256), 0).astype(np.uint8)


def symbols(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, three blanks before each, and the borders with these."""
    low = lowered(data)
    latin = np.zeros(len(low), bool)
    latin[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low[latin] += 0x20
    out = np.zeros(len(low) + 3 * (len(borders) - 1), np.uint8)
    places = borders + 3 * np.arange(len(borders))
    keep = np.ones(len(out), bool)
    keep[(places[:-1, None] + np.arange(3)).ravel()] = False
    out[keep] = _SYMBOL[low]
    return out, places


def grams(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The last four symbols at every symbol of a text, as one number."""
    s, places = symbols(data, borders)
    s = s.astype(np.uint32)
    g = s.copy()
    for k in (1, 2, 3):
        g[k:] |= s[:-k] << np.uint32(8 * k)
    keep = np.ones(len(s), bool)
    keep[(places[:-1, None] + np.arange(3)).ravel()] = False
    return g[keep]


def counts(docs: DataFrame) -> pd.DataFrame:
    """How often each language has each run of four symbols; summed in the tasks first, bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, borders = utf8(text_column(part))
                langs = part.column("lang").to_pylist()
                g = grams(data, borders)
                names = sorted(set(langs))
                lang = np.repeat([names.index(x) for x in langs], np.diff(borders))
                key, n = np.unique(lang.astype(np.uint64) << np.uint64(32) | g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in (key >> np.uint64(32)).tolist()], pa.string()),
                                                  pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    found = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()


@dataclass
class Model:
    """Code lengths in bits: ``table[state * symbols + symbol, language]``; ``state_of`` has the state of each context."""

    langs: list[str]
    symbol_of: np.ndarray
    size: int
    state_of: np.ndarray
    table: np.ndarray


def _below(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of contexts (rows) from counts and from the probabilities one order below."""
    total, distinct = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    seen = n > 0
    left = 1 - np.where(seen, lower, 0).sum(1, keepdims=True)
    full = distinct == n.shape[1]
    escape = np.where(full, 0, distinct / np.maximum(1, total + distinct))
    known = n / np.maximum(1, np.where(full, total, total + distinct))
    other = np.where(total > 0, escape * lower / np.maximum(left, 1e-300), lower)
    return np.where(seen, known, other)


def fit(found: pd.DataFrame) -> Model:
    """Trees and code lengths from the counts."""
    import pandas as pd

    langs = sorted(found["lang"].unique())
    g = found["gram"].to_numpy(np.int64)
    parts = [(g >> (8 * k)) & 255 for k in (3, 2, 1, 0)]
    used = np.union1d(np.unique(parts[3]), [0])
    a = len(used) + 1                                   # and one symbol for all that were never seen
    symbol_of = np.full(256, a - 1, np.int64)
    symbol_of[used] = np.arange(len(used))
    c3, c2, c1, s = (symbol_of[p] for p in parts)
    context = (c3 * a + c2) * a + c1
    lang = np.searchsorted(langs, found["lang"].to_numpy())
    n = found["n"].to_numpy(np.float64)
    frame = pd.DataFrame({"lang": lang, "context": context, "n": n}).groupby(["lang", "context"])["n"].sum()
    deep = np.unique(frame[frame >= MIN_CONTEXT].index.get_level_values("context"))
    state_of = np.tile(np.arange(a * a, dtype=np.int32), a)
    state_of[deep] = a * a + np.arange(len(deep), dtype=np.int32)
    table = np.empty(((a * a + len(deep)) * a, len(langs)), np.float32)
    for k in range(len(langs)):
        own = lang == k
        zero = np.bincount(s[own], n[own], a)[None, :]
        p0 = _below(zero, np.full((1, a), 1 / a))
        p1 = _below(np.bincount(c1[own] * a + s[own], n[own], a * a).reshape(a, a), np.repeat(p0, a, 0))
        p2 = _below(np.bincount((c2[own] * a + c1[own]) * a + s[own], n[own], a ** 3).reshape(a * a, a), np.tile(p1, (a, 1)))
        there = own & np.isin(context, deep)
        three = np.bincount(np.searchsorted(deep, context[there]) * a + s[there], n[there], len(deep) * a).reshape(len(deep), a)
        p3 = _below(three, p2[deep % (a * a)])
        table[:, k] = -np.log2(np.maximum(np.concatenate([p2, p3]), 1e-12)).ravel()
    return Model(langs, symbol_of, a, state_of, table)


def sampled(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """About ``per_lang`` documents of every language, chosen by a hash of the row's id."""
    known = docs.where("lang IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return known.join(F.broadcast(sizes), "lang").where(draw * F.col("_n") < per_lang).select("lang", "text")      # one row per language


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> Model | None:
    """Model from columns doc_id, text and lang; None if no row has a language."""
    found = counts(sampled(docs, per_lang))
    return fit(found) if len(found) else None


def code_lengths(model: Model, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Bits of every text under every language."""
    raw, places = symbols(data, borders)
    s = model.symbol_of[raw]
    a = model.size
    context = np.zeros(len(s), np.int64)
    for k in (3, 2, 1):
        context *= a
        context[k:] += s[:-k]
    bits = model.table[model.state_of[context].astype(np.int64) * a + s]
    bits[(places[:-1, None] + np.arange(3)).ravel()] = 0
    return np.add.reduceat(bits, places[:-1], axis=0, dtype=np.float64)


def _judged(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every text."""
    data, borders = utf8(texts)
    bits = code_lengths(model, data, borders)
    score = 1 / np.exp2(np.maximum(-1000, bits.min(1, keepdims=True) - bits)).sum(1)
    low = lowered(data)
    letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])[borders]
    lang = np.array(model.langs, object)[bits.argmin(1)]
    for k in np.flatnonzero(np.diff(letters) == 0):
        if not _LETTER.search(texts[int(k)].as_py()):
            lang[k], score[k] = UND, 0.0
    return lang, score


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row with columns doc_id and text."""
    if model is None:
        return docs.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)        # bounded by the sample: contexts x symbols x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                lang, score = _judged(model, text_column(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PREDICTED)


def known(docs: DataFrame, model: Model | None, least: float = LEAST_SCORE) -> DataFrame:
    """The documents with a language (score >= ``least``), with all their columns; none without a model."""
    if model is None:
        return docs.where("false")
    shared = docs.sparkSession.sparkContext.broadcast(model)        # bounded by the sample, as in :func:`predict`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                lang, score = _judged(shared.value, text_column(part))
                yield part.filter(pa.array((lang != UND) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
