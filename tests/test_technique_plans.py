"""The joins below the technique queries."""

import re

from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.operators import techniques, verdict
from mailquarry.plans import queries, scoring


def test_techniques_join_only_the_look_ups_that_they_read(spark, sf):
    mails = queries.mail_table(spark, sf)
    snap = queries.snapshots(spark, mails)
    found = queries._technique_input(spark, sf)
    plan = found.select(techniques.rule_array().alias("_rules"), *L.FEATURE_TECHNIQUES)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin LeftOuter, .*mail_id", plan)) == 2         # registration and certificates
    whole = scoring.with_snapshots(scoring.mail_facts(mails), mails, snap).drop("ai_brand").withColumn("prob", queries.fixed_probability())
    whole = whole.withColumn("ai_brand", F.lit(None).cast("string")).withColumn("verdict", verdict.ml_verdict(F.col("prob")))
    rows = lambda df: sorted(map(str, techniques.with_techniques(df).select("mail_id", "verdict", "techniques").collect()))
    assert rows(found) == rows(whole)
