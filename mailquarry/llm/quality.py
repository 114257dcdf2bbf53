"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

The n-grams are hashed: words, pairs of words, and runs of one to three word shapes (the classes of a word's characters
without repeats, and whether the word repeats the one before). An indicator is multiplied by the log of the ratio of
its frequencies in the two classes, rows are brought to length one, and a hinge-loss model is fitted by dual coordinate
descent. Margins become probabilities by a logistic curve fitted on a part of the sample that the model doesn't see.

The fit uses a bounded sample of ``TRAIN_ROWS`` labelled rows, chosen by a hash. Null texts count as empty; a text
without a word has the bias alone. Rows without a label are not learned from; without labels of both classes every score
is the share of class one, or 0.5 without any label. Repeated rows get equal scores, other columns are ignored, texts
are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.arrays import K1, K2, K3, lowered, mix, prefix_hash, slices, span_hash, text_column, utf8, words

TRAIN_ROWS = 8000           # labelled rows, about
HELD_FOR_CURVE = 5          # every fifth of them fits the curve
BUCKETS = 1 << 18
SMOOTH = 1.0
COST = 1.0
MIX_MEAN = 0.25             # share of the pure ratio in the final weights
EPOCHS = 30
SCORED = "doc_id long, score double"
_KIND = np.array([3 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else b + 4 for b in range(256)], np.uint8)


def _shapes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each word's character classes, runs of one class as one."""
    kind = _KIND[data]
    upper = np.zeros(len(data), bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] <= 0x9E)
    kind[upper] = 1
    kind[:-1][upper[1:]] = 1
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return span_hash(prefix_hash(kind[keep]), at[start], at[stop])


def features(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, sorted."""
    start, stop, text = words(data, borders)
    word = span_hash(prefix_hash(lowered(data)), start, stop)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    shape = _shapes(data, start, stop) + same.astype(np.uint64) * K2
    found = [(text, word * K1), (text, shape * K2)]
    for h, n, k in ((word, 2, K3), (shape, 2, K1 ^ K3), (shape, 3, K2 ^ K3)):
        if len(h) >= n:
            run = h[n - 1:].copy()
            for j in range(1, n):
                run += mix(h[n - 1 - j:len(h) - j] + np.uint64(j))
            ok = text[n - 1:] == text[:len(text) - n + 1]
            found.append((text[n - 1:][ok], (run * k)[ok]))
    owner = np.concatenate([t for t, _ in found])
    bucket = mix(np.concatenate([h for _, h in found])) % np.uint64(BUCKETS)
    key = np.unique(owner.astype(np.int64) * BUCKETS + bucket.astype(np.int64))
    return key // BUCKETS, key % BUCKETS


def ratios(without: np.ndarray, with_: np.ndarray) -> np.ndarray:
    """Log-count ratio of every bucket, from the rows of class zero and of class one that have it."""
    p, q = SMOOTH + with_, SMOOTH + without
    return np.log((p / p.sum()) / (q / q.sum()))


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of the hinge-loss model by dual coordinate descent."""
    w, alpha, rng = np.zeros(BUCKETS + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([v @ v + 1 for v in values])
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gap = sign[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - gap / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                w[-1] += step
                moved = max(moved, abs(step) / cost[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve (Newton steps on smoothed targets)."""
    ones, zeros = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x, b = np.stack([margin, np.ones(len(margin))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * b)
        b += step
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


@dataclass
class Model:
    """``score = 1 / (1 + exp(-(slope * margin + offset)))`` with ``margin = ratio-scaled indicators . weight / length + bias``."""

    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    def score(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        owner, bucket = features(data, borders)
        n = len(borders) - 1
        r = self.ratio[bucket]
        length = np.sqrt(np.bincount(owner, r * r, n))
        margin = np.bincount(owner, r * self.weight[bucket], n) / np.maximum(length, 1e-12) + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit(rows: list[np.ndarray], label: np.ndarray, held: np.ndarray) -> Model:
    """Model from the buckets of every row of the sample; ``held`` marks the rows for the curve."""
    if len(set(label.tolist())) < 2 or len(set(label[~held].tolist())) < 2:
        share = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.5
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS + 1), 0.0, float(np.log(share / (1 - share))))
    train = np.flatnonzero(~held)
    seen = np.array([sum(np.bincount(rows[i], minlength=BUCKETS) for i in train if label[i] == c) for c in (0, 1)])
    ratio = ratios(*seen)
    values = [ratio[r] / max(1e-12, np.linalg.norm(ratio[r])) for r in rows]
    sign = np.where(label == 1, 1.0, -1.0)
    weight_of = len(label) / (2 * np.maximum(1, np.bincount(label, minlength=2)))
    w = descend([rows[i] for i in train], [values[i] for i in train], sign[train], COST * weight_of[label[train]])
    w[:-1] = (1 - MIX_MEAN) * w[:-1] + MIX_MEAN * np.abs(w[:-1]).mean()
    test = np.flatnonzero(held) if len(set(label[held].tolist())) == 2 else train
    margin = np.array([w[rows[i]] @ values[i] + w[-1] for i in test])
    slope, offset = curve(margin, label[test])
    return Model(ratio, w, slope, offset)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Model from texts (doc_id, text) and labels (doc_id, label 0 or 1)."""
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select(F.col("doc_id").cast("long"), F.col("label").cast("int")).distinct()
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = known.where(draw * F.lit(known.count()) < rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")        # bounded by ``rows``
    held = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(HELD_FOR_CURVE)) == 0

    def indicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owner, bucket = features(*utf8(text_column(part)))
                cut = np.searchsorted(owner, np.arange(1, part.num_rows))
                rows = [b.astype("<i4").tobytes() for b in np.split(bucket, cut)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary()), part.column("label"), part.column("held")], ["doc_id", "buckets", "label", "held"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, label, held = [], [], []
        for batch in batches:
            rows += [np.frombuffer(b, "<i4") for b in batch.column("buckets").to_pylist()]
            label += batch.column("label").to_pylist()
            held += batch.column("held").to_pylist()
        if rows:
            m = fit(rows, np.array(label, np.int64), np.array(held, bool))
            yield pa.RecordBatch.from_arrays([pa.array([m.ratio.astype("<f8").tobytes()]), pa.array([m.weight.astype("<f8").tobytes()]),
                                              pa.array([m.slope]), pa.array([m.offset])], ["ratio", "weight", "slope", "offset"])

    marked = sample.select("doc_id", "text", "label", held.alias("held")).mapInArrow(indicate, "doc_id long, buckets binary, label int, held boolean")
    ordered = marked.repartition(1).sortWithinPartitions("doc_id", "buckets", "label")       # the bounded sample
    found = ordered.mapInArrow(learn, "ratio binary, weight binary, slope double, offset double").collect()
    if not found:
        return fit([], np.zeros(0, np.int64), np.zeros(0, bool))
    m = found[0]
    return Model(np.frombuffer(m.ratio, "<f8"), np.frombuffer(m.weight, "<f8"), m.slope, m.offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row with columns doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)            # bounded by BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = shared.value.score(*utf8(text_column(part)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)
