"""Isolation forest for unseen attacks, trained on legitimate mail only.

Trees need few rows each, so the training table is read twice (ranges, sample) and every tree is grown in
its own task. The forest is bounded by trees x sample size and is broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 3)
    out = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, out))


def _grow(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        tree = int(rows["tree"].iloc[0])
        data = np.array(rows["vec"].tolist(), dtype="float64")
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(len(data), 2))))
        nodes: list[tuple] = []
        todo = [(np.arange(len(data)), 0, -1, "")]
        while todo:
            idx, depth, parent, side = todo.pop()
            node = len(nodes)
            if parent >= 0:
                nodes[parent][side] = node
            part = data[idx]
            spread = part.max(axis=0) - part.min(axis=0)
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(idx) <= 1 or len(usable) == 0:
                nodes.append({"feature": -1, "threshold": 0.0, "left": -1, "right": -1, "depth": float(depth + average_path(len(idx)))})
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            below = part[:, f] <= cut
            nodes.append({"feature": f, "threshold": cut, "left": -1, "right": -1, "depth": 0.0})
            todo.append((idx[~below], depth + 1, node, "right"))
            todo.append((idx[below], depth + 1, node, "left"))
        out = pd.DataFrame(nodes)
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        return out

    return run


def _pack(nodes: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    return [tuple(g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth"))
            for _, g in nodes.sort_values(["tree", "node"]).groupby("tree")]


def _path_lengths(forest: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    row = np.arange(len(x))
    for feature, threshold, left, right, depth in forest:
        at = np.zeros(len(x), dtype="int64")
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go_left = x[row, np.maximum(f, 0)] <= threshold[at]
            at = np.where(inner, np.where(go_left, left[at], right[at]), at)
        total += depth[at]
    return total / max(len(forest), 1)


@dataclass
class OutlierForest:
    """Fitted forest: nodes, sample size, feature ranges and the score range seen in training."""

    nodes: pd.DataFrame
    psi: int
    low: np.ndarray
    high: np.ndarray
    score_low: float = 0.0
    score_high: float = 1.0

    @classmethod
    def fit(cls, df: DataFrame, id_col: str = "mail_id", vec: str = "vec", label: str | None = "label",
            trees: int = 200, max_sample: int = 256, seed: int = 42) -> OutlierForest:
        """Grow the forest on rows with label 0."""
        data = df.where(F.col(label) == 0) if label else df
        data = data.select(F.col(id_col).alias("id"), clean_array(F.col(vec)).alias("vec"))
        stats = data.select(Summarizer.metrics("min", "max", "count").summary(array_to_vector("vec")).alias("s")).select("s.*").first()
        n = int(stats["count"])
        if n == 0:
            raise ValueError("no legitimate rows to learn from")
        low, high = stats["min"].toArray(), stats["max"].toArray()
        psi = min(max_sample, n)
        unit = lambda *cols: F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / float(1 << 40)
        # Every tree takes the psi rows with its smallest hashes. Only hashes under 2 psi / n are offered, about 2 psi rows a
        # tree at any n; fewer than psi would be 16 deviations off. Hashes are tested inside the row, before it is repeated.
        draws = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), unit(t, "id").alias("_u"))),
                         lambda s: s["_u"] < 2.0 * psi / n)
        chosen = data.select("id", "vec", F.inline(draws))
        order = Window.partitionBy("tree").orderBy("_u", "id")
        picked = chosen.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= psi)
        scaled = picked.select("tree", "id", _scaled(F.col("vec"), low, high).alias("vec"))
        nodes = scaled.groupBy("tree").applyInPandas(_grow(seed), NODES).toPandas()     # <= trees * 2 * psi rows
        out = cls(nodes, psi, low, high)
        span = out.raw_scores(data.withColumnRenamed("id", id_col), id_col, "vec").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).first()
        out.score_low, out.score_high = float(span["a"]), float(span["b"])
        return out

    def _scorer(self, spark: SparkSession):
        shared = spark.sparkContext.broadcast((_pack(self.nodes), float(average_path(self.psi)), self.low, self.high))

        def values(x: np.ndarray) -> np.ndarray:
            forest, norm, low, high = shared.value
            span = np.where(high > low, high - low, 1.0)
            return np.power(2.0, -_path_lengths(forest, (np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0) - low) / span) / max(norm, 1e-12))

        return values

    def raw_scores(self, df: DataFrame, id_col: str = "mail_id", vec: str = "vec") -> DataFrame:
        """``raw`` in (0, 1]: the higher, the easier a row is isolated."""
        values = self._scorer(df.sparkSession)

        @F.pandas_udf("double")
        def raw(v: pd.Series) -> pd.Series:
            return pd.Series(values(np.array(v.tolist(), dtype="float64"))) if len(v) else pd.Series([], dtype="float64")

        return df.select(id_col, raw(F.col(vec).cast("array<double>")).alias("raw"))

    def scores(self, df: DataFrame, id_col: str = "mail_id", vec: str = "vec", per_batch: bool = False) -> DataFrame:
        """``anomaly_score`` in [0, 1], scaled with the range seen in training.

        With ``per_batch`` the range of the scored table is used instead.
        """
        raw = self.raw_scores(df, id_col, vec)
        if per_batch:
            span = raw.agg(F.min("raw").alias("_a"), F.max("raw").alias("_b"))
            raw = raw.join(F.broadcast(span))
            a, b = F.col("_a"), F.col("_b")
        else:
            a, b = F.lit(self.score_low), F.lit(self.score_high)
        part = F.when(b == a, F.lit(0.5)).otherwise((F.col("raw") - a) / (b - a))
        return raw.select(id_col, F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)).alias("anomaly_score"))

    def drivers(self, df: DataFrame, names: list[str], top: int = 10, id_col: str = "mail_id", vec: str = "vec") -> DataFrame:
        """``feature, value, impact`` of the ``top`` features whose zeroing changes the score most."""
        values = self._scorer(df.sparkSession)
        span = max(self.score_high - self.score_low, 1e-12)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), 512):
                    part = batch.iloc[start:start + 512]
                    x = np.array(part[vec].tolist(), dtype="float64")
                    base = values(x)
                    impact = np.empty_like(x)
                    for f in range(x.shape[1]):
                        changed = x.copy()
                        changed[:, f] = 0.0
                        impact[:, f] = (base - values(changed)) / span
                    order = np.argsort(-np.abs(impact), axis=1, kind="stable")[:, :top]
                    rows = np.repeat(np.arange(len(x)), order.shape[1])
                    cols = order.ravel()
                    yield pd.DataFrame({id_col: part[id_col].to_numpy()[rows], "rank": np.tile(np.arange(1, order.shape[1] + 1), len(x)).astype("int32"),
                                        "feature": np.array(names, dtype=object)[cols], "value": x[rows, cols], "impact": impact[rows, cols]})

        return df.select(id_col, F.col(vec).cast("array<double>").alias(vec)).mapInPandas(
            run, f"{id_col} bigint, rank int, feature string, value double, impact double")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = [(int(self.psi), self.low.tolist(), self.high.tolist(), self.score_low, self.score_high)]
        spark.createDataFrame(meta, "psi int, low array<double>, high array<double>, score_low double, score_high double") \
            .write.mode("overwrite").parquet(f"{path}/ranges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OutlierForest:
        m = spark.read.parquet(f"{path}/ranges").first()
        return cls(spark.read.parquet(f"{path}/nodes").toPandas(), m["psi"], np.array(m["low"]), np.array(m["high"]), m["score_low"], m["score_high"])


def clean_array(vec: Column) -> Column:
    """Values that are not finite become 0."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.transform(vec.cast("array<double>"), lambda x: F.when(bad(x), F.lit(0.0)).otherwise(x))


def _scaled(vec: Column, low: np.ndarray, high: np.ndarray) -> Column:
    span = np.where(high > low, high - low, 1.0)
    lows, spans = (F.array(*[F.lit(float(v)) for v in a]) for a in (low, span))
    shifted = F.zip_with(vec, lows, lambda x, a: x - a)
    return F.zip_with(shifted, spans, lambda x, s: x / s)


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale columns to [0, 1]; constant columns become 0."""
    span = df.agg(*[F.min(c).alias(f"_a_{c}") for c in columns], *[F.max(c).alias(f"_b_{c}") for c in columns])
    scaled = []
    for c in columns:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        scaled.append(((F.col(c) - a) / F.when(b == a, F.lit(1.0)).otherwise(b - a)).alias(c))
    return df.join(F.broadcast(span)).select(*[c for c in df.columns if c not in columns], *scaled)
