"""Training and scoring with Spark ML, oversampling, folds and random search."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.operators import forest
from mailquarry.operators.corpus import assign_folds, class_weights
from mailquarry.plans.staging import written

MODELS = ["lr", "rf", "gbt_depth", "gbt_leaf", "gbt_plain"]
# Presets of the boosted-tree family: depth-wise, more and shallower splits, no row sampling.
_GBT = {
    "gbt_depth": {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    "gbt_leaf": {"maxIter": 300, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"},
    "gbt_plain": {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"},
}


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns only lose their mean."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.join(F.broadcast(stats))
    scaled = [((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))).alias(c) for c in columns]
    return joined.select(*[c for c in df.columns if c not in columns], *scaled)


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Add the balanced ``weight``; the weight table has one row per class."""
    return df.join(F.broadcast(class_weights(df, label, digits=None).select(label, "weight")), label)


class SummaryFreePipeline(Pipeline):
    """A pipeline whose fitted models carry no training summary.

    A summary keeps the session, and goes with the model into every task; after the session's first ``observe`` it can't be serialised.
    """

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        model = super()._fit(dataset)
        for stage in model.stages:
            if getattr(stage, "hasSummary", False):
                stage._java_obj.setSummary(dataset.sparkSession._jvm.scala.Option.empty())
        return model


TREES_AT_ONCE = 25          # trees of one fit; fixed, so that a forest doesn't depend on the cluster
FITS_AT_ONCE = 12
PARTITION_ROWS = 100_000


class GroupedForest(RandomForestClassifier):
    """A random forest whose trees are grown in groups side by side, each with its own seed, and joined into one model.

    Every partition holds and shuffles statistics of all open nodes, and a deep tree has nearly as many nodes as rows; so partitions
    are few and large (``PARTITION_ROWS``), and the groups, not the partitions, keep the cores busy.
    """

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        spark = dataset.sparkSession
        data = written(dataset.select(self.getFeaturesCol(), self.getLabelCol(), *([self.getWeightCol()] if self.isDefined(self.weightCol) else [])))
        data = data.coalesce(max(1, math.ceil(data.count() / PARTITION_ROWS)))
        sizes = [min(TREES_AT_ONCE, self.getNumTrees() - start) for start in range(0, self.getNumTrees(), TREES_AT_ONCE)]
        grow = lambda i: RandomForestClassifier._fit(self.copy({self.numTrees: sizes[i], self.seed: self.getSeed() + i}), data)
        if len(sizes) == 1:
            return grow(0)
        with ThreadPool(FITS_AT_ONCE) as pool:
            groups = pool.map(inheritable_thread_target(spark)(grow), range(len(sizes)))
        grown = [tree for g in groups for tree in g._java_obj.trees()]
        kind = spark._jvm.org.apache.spark.ml.classification
        trees = spark.sparkContext._gateway.new_array(kind.DecisionTreeClassificationModel, len(grown))
        for i, tree in enumerate(grown):
            trees[i] = tree
        joined = RandomForestClassificationModel(kind.RandomForestClassificationModel(self.uid, trees, groups[0].numFeatures, groups[0].numClasses))
        self._copyValues(joined)._transfer_params_to_java()          # saving reads the number of trees there
        return joined


def _forest(params: dict | None) -> dict:
    """Size of a random forest by ``params`` and the defaults."""
    p = params or {}
    return {"trees": p.get("n_estimators", 300), "depth": min(p.get("max_depth", 20), 30), "least": max(p.get("min_samples_split", 4) // 2, 1), "max_features": p.get("max_features", "sqrt")}


def build(name: str, params: dict | None = None, seed: int = 42, rows: int = 1) -> Pipeline:
    """Estimator pipeline of a model name; ``params`` override the defaults.

    ``C`` of the logistic regression weighs the sum of the losses of all ``rows`` against the penalty; Spark takes their mean.
    """
    p = dict(params or {})
    if name == "lr":
        c = p.pop("C", 1.0)
        lr = LogisticRegression(featuresCol="scaled", weightCol="weight", maxIter=p.pop("max_iter", 1000), regParam=1.0 / (c * max(rows, 1)), **p)
        return SummaryFreePipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), lr])
    if name == "rf":
        f = _forest(p)
        rf = {"numTrees": f["trees"], "maxDepth": f["depth"], "minInstancesPerNode": f["least"], "featureSubsetStrategy": f["max_features"]}
        return SummaryFreePipeline(stages=[GroupedForest(weightCol="weight", seed=seed, **rf)])
    if name in _GBT or name == "gbt":
        g = dict(_GBT.get(name, _GBT["gbt_depth"]))
        for ours, theirs in (("n_estimators", "maxIter"), ("max_depth", "maxDepth"), ("learning_rate", "stepSize"), ("subsample", "subsamplingRate")):
            if ours in p:
                g[theirs] = p[ours]
        return SummaryFreePipeline(stages=[GBTClassifier(weightCol="weight", seed=seed, **g)])
    raise ValueError(f"unknown model: {name}")


def fitted(name: str, df: DataFrame, params: dict | None = None, seed: int = 42, rows: int = 1) -> PipelineModel | forest.Forest:
    """The model of a name, fitted; a forest as a table of nodes, since its trees can be larger than the driver."""
    if name != "rf":
        return build(name, params, seed, rows).fit(df)
    return forest.fit(df, seed=seed, **_forest(params))


def score(model: PipelineModel | forest.Forest, df: DataFrame, keep: Sequence[str] = ("mail_id", "label")) -> DataFrame:
    """Probability of class 1 per row."""
    if isinstance(model, forest.Forest):
        return model.score(df, keep)
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("prob"))


def linear_terms(model: PipelineModel, names: Sequence[str]) -> tuple[list[tuple[str, float]], float]:
    """Weight of every plain feature and the intercept of a fitted logistic pipeline, its scaling taken in."""
    scaler, lr = model.stages[0], model.stages[-1]
    std, mean, coef = (np.asarray(v.toArray()) for v in (scaler.std, scaler.mean, lr.coefficients))
    weight = np.where(std > 0, coef / np.where(std > 0, std, 1), 0.0)
    return [(n, float(w)) for n, w in zip(names, weight, strict=True)], float(lr.intercept - (weight * mean).sum())


def centroid_terms(df: DataFrame, names: Sequence[str], label: str = "label") -> tuple[list[tuple[str, float]], float]:
    """Weights and intercept of the linear rule between the class means, with one variance per feature (the pooled one).

    It needs one pass and has no iterations, so it is the model to start from. Features without variance have no weight.
    """
    y = F.col(label) == 1
    stats = df.agg(F.count_if(y).alias("n1"), F.count_if(~y).alias("n0"), *[f(F.when(c, F.col(n).cast("double"))).alias(f"{k}{i}")
                   for i, n in enumerate(names) for k, f, c in (("m1_", F.avg, y), ("m0_", F.avg, ~y), ("v1_", F.var_pop, y), ("v0_", F.var_pop, ~y))]).first()
    if not stats["n1"] or not stats["n0"]:
        raise ValueError("both classes are needed")
    n1, n0 = stats["n1"], stats["n0"]
    terms, intercept = [], math.log(n1 / n0)
    for i, name in enumerate(names):
        m1, m0, v1, v0 = (stats[f"{k}{i}"] for k in ("m1_", "m0_", "v1_", "v0_"))
        pooled = (n1 * v1 + n0 * v0) / (n1 + n0)
        weight = (m1 - m0) / pooled if pooled > 0 else 0.0
        terms.append((name, weight))
        intercept -= weight * (m1 + m0) / 2
    return terms, intercept


def f1_expr(label: str = "label", predicted: str = "predicted") -> Column:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    tp, wrong = F.count_if(y & p), F.count_if(y != p)
    return F.when(tp == 0, F.lit(0.0)).otherwise(2 * tp / (2 * tp + wrong))


def cross_validate(name: str, df: DataFrame, k: int = 3, params: dict | None = None, seed: int = 42,
                   smote: bool = False) -> dict[str, float]:
    """F1 mean and deviation over stratified folds. Oversampling touches the training part of a fold only."""
    folds = written(assign_folds(df, k, seed))
    scores = []
    for i in range(k):
        train, test = folds.where(F.col("fold") != i).drop("fold"), folds.where(F.col("fold") == i)
        train = oversample(train, seed=seed) if smote else train
        model = fitted(name, with_class_weight(train), params, seed, train.count())
        pred = score(model, test).withColumn("predicted", (F.col("prob") >= L.PREDICT_THRESHOLD).cast("int"))
        scores.append(pred.agg(f1_expr().alias("f1")).first()["f1"])
    return {"cv_f1_mean": float(np.mean(scores)), "cv_f1_std": float(np.std(scores))}


def train_all(df: DataFrame, names: Sequence[str] = tuple(MODELS), params: dict[str, dict] | None = None, k: int = 3,
              seed: int = 42, smote: bool = False) -> tuple[dict[str, PipelineModel | forest.Forest], dict[str, dict], str]:
    """Fit every model on all rows; returns models, cross-validation scores and the best name."""
    params = params or {}
    full = oversample(df, seed=seed) if smote else df
    weighted = written(with_class_weight(full))
    rows = weighted.count()
    models, scores = {}, {}
    for name in names:
        scores[name] = cross_validate(name, df, k, params.get(name), seed, smote)
        models[name] = fitted(name, weighted, params.get(name), seed, rows)
    return models, scores, max(scores, key=lambda n: scores[n]["cv_f1_mean"])


def random_grid(name: str, trials: int = 50, seed: int = 42) -> list[dict]:
    """Seeded random draws from the search space of a model."""
    rng = random.Random(f"{name}-{seed}")
    out = []
    for _ in range(trials):
        draw = {}
        for key, space in L.SEARCH_SPACES["gbt" if name in _GBT else name].items():
            if isinstance(space, list):
                draw[key] = rng.choice(space)
            elif key in L.LOG_UNIFORM:
                draw[key] = math.exp(rng.uniform(math.log(space[0]), math.log(space[1])))
            elif isinstance(space[0], int):
                draw[key] = rng.randint(*space)
            else:
                draw[key] = rng.uniform(*space)
        out.append(draw)
    return out


def tune(name: str, df: DataFrame, trials: int = 50, k: int = 3, seed: int = 42, parallelism: int = 4) -> tuple[dict, list[tuple[dict, float]]]:
    """Best draw by mean F1 over stratified folds, with all scored draws.

    Every draw is one pipeline in a parameter grid, so Spark ML runs several at a time on shared folds.
    """
    draws = random_grid(name, trials, seed)
    folds = written(with_class_weight(assign_folds(df, k, seed)).withColumn("fold", F.col("fold").cast("int")))
    rows = folds.count() * (k - 1) // k        # of a training part
    shell = SummaryFreePipeline(stages=[])
    grid = [{shell.stages: build(name, d, seed, rows).getStages()} for d in draws]
    cv = CrossValidator(estimator=shell, estimatorParamMaps=grid, foldCol="fold", numFolds=k, parallelism=parallelism,
                        evaluator=MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0))
    means = list(cv.fit(folds).avgMetrics)
    scored = list(zip(draws, means, strict=True))
    return max(scored, key=lambda s: s[1])[0], scored


# --- neighbours and oversampling ----------------------------------------------------------

BLOCK_ROWS = 4096


def _blocks(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """``ids, vecs``: one row per block of about ``BLOCK_ROWS`` rows."""
    n = max(1, math.ceil(df.count() / BLOCK_ROWS))
    block = F.pmod(F.xxhash64(id_col, vec), F.lit(n))
    row = F.struct(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    return df.groupBy(block.alias("_block")).agg(F.collect_list(row).alias("_rows")).select(F.col("_rows.id").alias("ids"), F.col("_rows.vec").alias("vecs"))


def nearest(queries: DataFrame, points: DataFrame, k: int, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """Exact k nearest other points of every query: ``id, rank, neighbour``; ids are unique, ties go to the smaller one.

    Blocks of queries meet blocks of points in tasks; k rows per query leave each pair of blocks and the best k of
    these remain. A product picks the candidates, their distances are then summed directly, so that a distance does
    not depend on the block.
    """
    q = _blocks(queries, id_col, vec).select(F.col("ids").alias("qids"), F.col("vecs").alias("qvecs"))
    pairs = q.crossJoin(_blocks(points, id_col, vec))

    def matrix(column: pa.ListArray, i: int) -> np.ndarray:
        rows = column[i].values
        return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qids, qvecs, ids, vecs = batch.columns
            for i in range(batch.num_rows):
                qid, pid = qids[i].values.to_numpy(), ids[i].values.to_numpy()
                at, pts = matrix(qvecs, i), matrix(vecs, i)
                square, own, take = (pts * pts).sum(axis=1), (at * at).sum(axis=1), min(k, len(pid))
                for start in range(0, len(qid), 256):
                    part, out = slice(start, start + 256), []
                    dist = square[None, :] - 2 * at[part] @ pts.T + own[part, None]
                    dist[(qid[part, None] == pid[None, :]) | ~np.isfinite(dist)] = np.inf
                    limit = np.partition(dist, take - 1, axis=1)[:, take - 1] + 1e-10 * (own[part] + square.max())
                    for j, row in enumerate(dist, start):
                        near = np.flatnonzero((row <= limit[j - start]) & np.isfinite(row))
                        exact = ((pts[near] - at[j]) ** 2).sum(axis=1)
                        best = np.lexsort((pid[near], exact))[:take]
                        out.append((np.full(len(best), qid[j]), pid[near[best]], exact[best]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "neighbour", "d"])

    found = pairs.mapInArrow(run, "id bigint, neighbour bigint, d double")
    order = Window.partitionBy("id").orderBy("d", "neighbour")        # cut to k rows before the shuffle
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("id").alias(id_col), "rank", "neighbour"))


def projected_neighbours(points: DataFrame, k: int, id_col: str = "id", vec: str = "vec", projections: int = 8,
                         reach: int = 12, cell_rows: int = 100_000, seed: int = 42) -> DataFrame:
    """Near neighbours for point sets of any size: ``id, rank, neighbour``.

    Points are sorted along random directions and compared with the ``reach`` points on either side, so
    work grows linearly and no group emits all its pairs. The order is cut into cells by range partitioning
    with the hash of the id as second key, so copies of one point stay balanced and the plan has one size.
    """
    head = points.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    cells = max(1, math.ceil((head["n"] or 0) / cell_rows))
    rng = np.random.default_rng(seed)
    found = None
    for p in range(projections):
        direction = F.array(*[F.lit(float(x)) for x in rng.normal(size=head["d"])])
        projected = points.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"), F.aggregate(
            F.zip_with(vec, direction, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b).alias("_x"))
        projected = projected.repartitionByRange(cells, F.col("_x"), F.xxhash64("id")).withColumn("_cell", F.spark_partition_id())
        near = Window.partitionBy("_cell").orderBy("_x", "id").rowsBetween(-reach, reach)
        pairs = (projected.withColumn("_near", F.collect_list(F.struct("id", "vec")).over(near))
                 .select("id", "vec", F.explode("_near").alias("_o")).where(F.col("_o.id") != F.col("id"))
                 .select("id", F.col("_o.id").alias("neighbour"), F.aggregate(
                     F.zip_with("vec", "_o.vec", lambda a, b: (a - b).cast("double")), F.lit(0.0), lambda s, x: s + x * x).alias("_d")))
        found = pairs if found is None else found.unionByName(pairs)
    best = found.groupBy("id", "neighbour").agg(F.min("_d").alias("_d"))
    order = Window.partitionBy("id").orderBy("_d", "neighbour")        # at most projections * 2 * reach rows
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("id").alias(id_col), "rank", "neighbour"))


def synthetic_rows(minority: DataFrame, missing: int, k: int = 5, seed: int = 42, id_col: str = "mail_id", vec: str = "vec") -> DataFrame:
    """``missing`` points on segments between minority points and one of their k neighbours: ``base, neighbour, u, vec``."""
    n = minority.count()
    if n < 2 or missing <= 0:
        return minority.select(F.col(id_col).alias("base"), F.col(id_col).alias("neighbour"), F.lit(0.0).alias("u"), vec).limit(0)
    pts = minority.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    near = projected_neighbours(pts, k)
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("_near"))
    # Every point is used missing // n times; the points with the smallest hashes once more.
    from mailquarry.operators.corpus import sample_exactly
    whole, extra = divmod(missing, n)
    uses = [lists.select("id", "_near", F.explode(F.sequence(F.lit(1), F.lit(whole))).alias("_copy"))] if whole else []
    if extra:
        picked = sample_exactly(lists.withColumnRenamed("id", "mail_id"), extra, seed).withColumnRenamed("mail_id", "id")
        uses.append(picked.select("id", "_near", F.lit(0).alias("_copy")))
    draws = uses[0] if len(uses) == 1 else uses[0].unionByName(uses[1])
    h = F.xxhash64(F.lit(seed), "id", "_copy")
    draws = draws.select(F.col("id").alias("base"), F.get("_near", F.pmod(h, F.size("_near")).cast("int"))["neighbour"].alias("neighbour"),
                         (F.pmod(F.xxhash64(F.lit(seed + 1), "id", "_copy"), F.lit(1_000_000)) / 1_000_000.0).alias("u"))
    a = pts.select(F.col("id").alias("base"), F.col("vec").alias("_a"))
    b = pts.select(F.col("id").alias("neighbour"), F.col("vec").alias("_b"))
    return draws.join(a, "base").join(b, "neighbour").select(
        "base", "neighbour", "u", F.zip_with("_a", "_b", lambda x, y: x + F.col("u") * (y - x)).alias(vec))


def oversample(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label", features: str = "features") -> DataFrame:
    """Add synthetic minority rows until both classes are equal; needs ``mail_id``, label and a vector column."""
    from pyspark.ml.functions import array_to_vector

    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}    # two rows
    if len(counts) < 2:
        return df
    minority = min(counts, key=counts.get)
    missing = max(counts.values()) - counts[minority]
    points = df.where(F.col(label) == minority).select("mail_id", vector_to_array(features).alias("vec"))
    made = synthetic_rows(points, missing, k, seed).select(
        F.xxhash64("base", "neighbour", "u").alias("mail_id"), F.lit(minority).cast(df.schema[label].dataType).alias(label),
        array_to_vector("vec").alias(features))
    return df.select("mail_id", label, features).unionByName(made)
