"""Which features drive a score: linear contributions, population importance, ranking agreement.

Everything about one mail happens inside its row: contributions are an array, the ranking sorts that array. Only the
population means shuffle, one partial sum per feature and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.operators import clean


def contributions(table: DataFrame, coefficients: DataFrame, names: Sequence[str], id_col: str = "mail_id") -> DataFrame:
    """``id, contributions``: per row an array of ``feature, value, contribution`` with contribution = coef * (value - mean).

    ``coefficients(feature, coef, mean)`` is folded to one row, a map over the model's features; features without an
    entry are left out.
    """
    folded = coefficients.where(F.col("feature").isin(list(names))).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("coef", "mean")))).alias("_coef"))
    values = F.array(*[F.struct(F.lit(n).alias("feature"), clean.zero_if_not_finite(F.col(n)).alias("value")) for n in names])
    pairs = F.filter(F.transform(values, lambda v: F.struct(v.alias("v"), F.element_at("_coef", v["feature"]).alias("c"))), lambda p: p["c"].isNotNull())
    made = F.transform(pairs, lambda p: F.struct(p["v"]["feature"].alias("feature"), p["v"]["value"].alias("value"),
                                                 (p["c"]["coef"] * (p["v"]["value"] - p["c"]["mean"])).alias("contribution")))
    return table.join(F.broadcast(folded)).select(id_col, made.alias("contributions"))        # one row by construction


def ranked(items: Column, by: str = "contribution", digits: int = 6) -> Column:
    """The array sorted by absolute size of a field, largest first; ties by name."""
    keyed = F.transform(items, lambda s: F.struct((-F.round(F.abs(s[by]), digits)).alias("k"), s["feature"].alias("feature"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def top_contributions(contrib: DataFrame, top: int = 15, id_col: str = "mail_id", digits: int = 6) -> DataFrame:
    """The ``top`` contributions of every row by absolute size."""
    shown = contrib.select(id_col, F.posexplode(F.slice(ranked(F.col("contributions"), digits=digits), 1, top)).alias("pos", "s"))
    return shown.select(id_col, (F.col("pos") + 1).alias("rank"), "s.feature", F.round("s.value", digits).alias("value"),
                        F.round("s.contribution", digits).alias("contribution"), (F.col("s.contribution") > 0).alias("raises_risk"))


def population_importance(contrib: DataFrame, digits: int = 6) -> DataFrame:
    """Mean absolute contribution per feature over a batch."""
    return contrib.select(F.inline("contributions")).groupBy("feature").agg(F.round(F.avg(F.abs("contribution")), digits).alias("importance"))


def rank_agreement(contrib: DataFrame, a: str = "contribution", b: str = "value", top: int = 5, id_col: str = "mail_id") -> DataFrame:
    """Jaccard similarity of the top features of a row under two rankings, by the fields ``a`` and ``b``."""
    best = lambda by: F.transform(F.slice(ranked(F.col("contributions"), by), 1, top), lambda s: s["feature"])
    both = contrib.select(id_col, best(a).alias("_a"), best(b).alias("_b"))
    union = F.size(F.array_union("_a", "_b"))
    return both.select(id_col, F.round(F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("_a", "_b")) / union), 6).alias("agreement"))
