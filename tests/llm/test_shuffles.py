"""What near-duplicate and set joins shuffle when no table is small enough to be broadcast."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailquarry.llm import neardup, setjoin


@pytest.fixture()
def large(spark):
    """A session that takes every table as too large to be broadcast, unless a hint says so."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


def exchanged(df):
    """Names of the columns in each exchange of a plan."""
    text = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.findall(r"\(\d+\) Exchange\b[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", text)
    assert found
    return [{c.strip().split("#")[0] for c in columns.split(",")} for columns in found]


def test_partners_shuffle_no_sets(large):
    sets = large.createDataFrame([(1, [10, 11, 12, 13, 14]), (2, [10, 11, 12, 13, 15]), (3, [20, 21]), (4, [20, 21])], "node long, elements array<long>")
    nodes = large.createDataFrame([(1,), (2,), (3,)], "node long")
    found = neardup._partners(nodes, sets, 0.6)
    assert all("elements" not in columns for columns in exchanged(found))
    rows = {r.node: (r.size, r.low, r.high) for r in found.collect()}
    assert rows[1] == rows[2] == (5, 3, 5)          # one element of five is alone: 4 * 1.6 / 0.6 - 5
    assert 4 not in rows                            # not asked for, even if the bitmap lets it pass


def test_bitmaps_of_long_sets_tell_them_apart(spark):
    sizes = [6000, 5500, 3000, 40]
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in sizes]
    sets.append(np.concatenate([sets[0][:5900], sets[1][:100]]))                # a near copy of the first
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits = setjoin._bitmaps(owner, np.concatenate(sets), len(sets))
    nodes = spark.createDataFrame([(i, len(s), b) for i, (s, b) in enumerate(zip(sets, bits.to_pylist()))], "node long, n long, bits array<long>")
    every = [(i, j, len(sets[i]), len(sets[j])) for i in range(5) for j in range(i)]
    pairs = spark.createDataFrame(every, "x long, y long, n long, m long")
    differ = pairs.join(nodes.selectExpr("node AS x", "bits AS b"), "x").join(nodes.selectExpr("node AS y", "bits AS c"), "y")
    for r in differ.select("x", "y", setjoin._differing(F.col("b"), F.col("c")).alias("d")).collect():
        assert r.d <= len(np.setxor1d(sets[r.x], sets[r.y]))
    assert [(r.x, r.y) for r in setjoin._able(pairs, nodes, "x", "y", 4, 5).collect()] == [(4, 0)]
