"""Exact order statistics without sorting a whole group in one task.

Ranking a handful of groups (two labels, a few models) with a window would put a large share of the
table into one task. Both helpers first count rows per bucket, turn the counts into running totals on
a table whose size is bounded by the number of buckets, and touch single rows only inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 4             # 65 536 buckets of a uniform hash
VALUE_BUCKETS = 512         # at least; more when the table is large
ROWS_PER_BUCKET = 1_000_000


def order_hash(id_col: Column, seed: int | str = 42) -> Column:
    """Reproducible pseudo-random order key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")))


def hash_cuts(ids: DataFrame, groups: list[str], wanted: DataFrame, hash_col: str = "h") -> DataFrame:
    """For every wanted rank of a group, the hash of the row at this rank.

    ``ids`` holds the group columns and ``hash_col``; ``wanted`` holds the group columns, ``target`` and
    ``rank`` (1-based). The result has one row per wanted rank with column ``cut``: rows with
    ``hash_col <= cut`` are exactly the first ``rank`` rows of the group. Only the buckets that contain a
    cut are ranked row by row.
    """
    bucketed = ids.withColumn("_bucket", F.substring(hash_col, 1, HASH_DIGITS))
    totals = bucketed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*groups).orderBy("_bucket")
    running = totals.withColumn("_upto", F.sum("_n").over(order)).withColumn("_before", F.col("_upto") - F.col("_n"))
    hit = (wanted.join(running, groups)
           .where((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_upto")))
           .select(*groups, "target", "_bucket", (F.col("rank") - F.col("_before")).alias("_offset")))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(hash_col)
    needed = hit.select(*groups, "_bucket").distinct()
    ranked = (bucketed.join(F.broadcast(needed), [*groups, "_bucket"])
              .withColumn("_rn", F.row_number().over(inside)))
    return (ranked.join(F.broadcast(hit), [*groups, "_bucket"])
            .where(F.col("_rn") == F.col("_offset"))
            .select(*groups, "target", F.col(hash_col).alias("cut")))


def running_totals(df: DataFrame, groups: list[str], value: str, measures: list[str]) -> DataFrame:
    """Per distinct ``value``: the sums of the measures, and their sums over all smaller values.

    Adds ``<measure>_before``. Equal values are merged first, so copies of one value cost one row. The
    bucket borders are approximate quantiles; they only decide where the work is split, not the result. Their
    number follows the row count, so a bucket holds about a million rows at any size.
    """
    merged = df.groupBy(*groups, value).agg(*[F.sum(m).alias(m) for m in measures])
    n = max(VALUE_BUCKETS, -(-df.count() // ROWS_PER_BUCKET))
    share = [F.lit(i / n) for i in range(1, n)]
    borders = merged.groupBy(*groups).agg(
        F.percentile_approx(value, F.array(*share), max(10000, 20 * n)).alias("_borders"))
    bucketed = (merged.join(F.broadcast(borders), groups)
                .withColumn("_bucket", F.size(F.filter(F.array_distinct("_borders"), lambda b: b <= F.col(value))))
                .drop("_borders"))
    sums = bucketed.groupBy(*groups, "_bucket").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*groups, "_bucket", *[
        F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}_offset") for m in measures])
    inside = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (bucketed.join(F.broadcast(offsets), [*groups, "_bucket"])
            .select(*groups, value, *measures, *[
                (F.coalesce(F.sum(m).over(inside), F.lit(0)) + F.col(f"_{m}_offset")).alias(f"{m}_before")
                for m in measures]))
