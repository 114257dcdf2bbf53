"""Connected components of a table of links, by contraction; links never leave the executors.

In a round every node points to its smallest smaller neighbour, the pointers are followed to their roots by doubling,
and the links are drawn between roots. Links inside one component vanish, so each round leaves fewer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.plans.staging import written


def _oriented(links: DataFrame) -> DataFrame:
    pairs = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    return written(pairs.where("high <> low").distinct())


def _shortened(hooks: DataFrame) -> DataFrame:
    """Pointers (node, root) straight to the roots."""
    while True:
        nearer = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        hooks = written(hooks.join(nearer, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if hooks.where("moved").isEmpty():
            return hooks.select("node", "root")
        hooks = hooks.select("node", "root")


def components(links: DataFrame) -> DataFrame | None:
    """Columns node and root (the smallest node of the component) for every node that isn't its own root; None without links."""
    edges, found = _oriented(links), None
    while not edges.isEmpty():
        hooks = _shortened(written(edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root"))))
        step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        if found is None:
            found = hooks
        else:
            moved = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            found = written(moved.unionByName(hooks))
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        drawn = edges.join(to("high"), "high", "left").join(to("low"), "low", "left")
        edges = _oriented(drawn.select(F.coalesce("high_root", "high").alias("a"), F.coalesce("low_root", "low").alias("b")))
    return found
