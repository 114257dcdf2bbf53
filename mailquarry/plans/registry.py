"""Published models: versions of a name in the shared folder, as tables that every engine can read.

A version is a folder that appears at once: its tables and its record are written beside it and then renamed, which fails
if another publisher was first; then the next number is taken. Readers see whole versions only, and none is ever changed.
A linear model is a table of terms, a tree ensemble a table of nodes, a vocabulary a table of terms with positions and weights.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.operators import clean, forest, learn, trees
from mailquarry.plans.staging import scratch

LINEAR, TREES, VOCABULARY = "linear", "trees", "vocabulary"
TERMS = "feature string, weight double"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _context(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    folder = _path(spark, f"{root}/{name}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n[1:]) for n in found if n[0] == "v" and n[1:].isdigit())


def appeared(spark: SparkSession, draft: str, root: str, name: str, number: int) -> bool:
    """Renames a written draft to a version; False if that number is taken."""
    context = _context(spark, root)
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(_path(spark, draft), _path(spark, f"{root}/{name}/v{number}"), none)
        return True
    except Py4JJavaError as e:
        if number not in versions(spark, root, name):
            raise RuntimeError(f"version {number} of {name} can't be published") from e
        return False


def publish(table: DataFrame, record: dict, root: str, name: str) -> int:
    """Publishes a table of terms or nodes with its record; returns the version."""
    spark = table.sparkSession
    draft = f"{root}/{name}/_{uuid.uuid4().hex}"
    (table if record["kind"] == TREES else table.coalesce(1)).write.parquet(f"{draft}/model")         # a forest can be larger than the training table
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(f"{draft}/record")
    number = max(versions(spark, root, name), default=0) + 1
    while not appeared(spark, draft, root, name, number):
        number += 1
    return number


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> tuple[DataFrame, dict]:
    """Table and record of a version, of the latest one by default."""
    number = max(versions(spark, root, name)) if version is None else version
    folder = f"{root}/{name}/v{number}"
    record = json.loads(spark.read.text(f"{folder}/record").first().value)
    return spark.read.parquet(f"{folder}/model"), record | {"version": number}


def publish_model(model: PipelineModel | forest.Forest, names: Sequence[str], root: str, name: str, record: dict | None = None) -> int:
    """Publishes a fitted pipeline of :func:`learn.build`: its terms or its nodes, in terms of the plain features."""
    spark = SparkSession.active()
    if isinstance(model, forest.Forest):
        table, own = model.nodes, {"kind": TREES, "link": model.link}
    elif hasattr(model.stages[-1], "coefficients"):
        terms, intercept = learn.linear_terms(model, names)
        table, own = spark.createDataFrame(terms, TERMS), {"kind": LINEAR, "intercept": intercept}
    else:
        table, link = trees.exported(model, scratch(spark))
        own = {"kind": TREES, "link": link}
    return publish(table, {**(record or {}), **own, "features": list(names)}, root, name)


def publish_vocabulary(vocabulary: DataFrame, names: Sequence[str], embedding_dim: int, root: str, name: str) -> int:
    """Publishes a vocabulary with the layout of the vectors over it: scalar names, width of the dense part, terms."""
    return publish(vocabulary, {"kind": VOCABULARY, "features": list(names), "embedding_dim": embedding_dim}, root, name)


def linear_probability(table: DataFrame, record: dict) -> Column:
    """Probability as an expression over the feature columns."""
    terms = sorted(table.collect())                     # one row per feature
    total = F.lit(float(record["intercept"]))
    for r in terms:
        total = total + F.lit(r.weight) * clean.zero_if_not_finite(F.col(r.feature).cast("double"))
    return 1 / (1 + F.exp(-total))


def scored(features: DataFrame, table: DataFrame, record: dict, id_col: str = "mail_id") -> DataFrame:
    """``id, prob`` of a feature table under a published model."""
    if record["kind"] == LINEAR:
        return features.select(id_col, linear_probability(table, record).alias("prob"))
    return trees.scored(features, table, record["link"], record["features"], id_col)


def train_and_publish(df: DataFrame, names: Sequence[str], root: str, name: str, models: Sequence[str] = tuple(learn.MODELS), **settings) -> dict:
    """Trains all models on ``label, features``, publishes the one with the best mean F1, and returns its record with all scores."""
    fitted, scores, best = learn.train_all(df, models, **settings)
    version = publish_model(fitted[best], names, root, name, {"model": best, "scores": scores})
    return load(df.sparkSession, root, name, version)[1]
