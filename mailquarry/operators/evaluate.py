"""Evaluation of scored mails: threshold metrics, exact AUC, stress, failure modes, error slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.operators.features import long_form
from mailquarry.operators.ranking import running_totals


def _metric_columns(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    zero = lambda num, den: F.when(den == 0, F.lit(0.0)).otherwise(num / den)
    d = lambda c: c.cast("double")
    product = F.sqrt(d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn))
    return {
        "precision": zero(d(tp), d(tp + fp)), "recall": zero(d(tp), d(tp + fn)), "f1": zero(2.0 * tp, d(2 * tp + fp + fn)),
        "mcc": zero(d(tp) * d(tn) - d(fp) * d(fn), product), "fnr": zero(d(fn), d(fn + tp)), "fpr": zero(d(fp), d(fp + tn)),
    }


def confusion_metrics(scored: DataFrame, groups: Sequence[str] = ("model",), threshold: float = L.PREDICT_THRESHOLD,
                      digits: int | None = 6) -> DataFrame:
    """Counts and rates per group; needs ``label`` and ``prob``."""
    y, p = F.col("label") == 1, F.col("prob") >= threshold
    counts = scored.groupBy(*groups).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
        F.count("*").alias("n_test"))
    rates = _metric_columns(*[F.col(c) for c in ("tp", "tn", "fp", "fn")])
    shown = [(F.round(e, digits) if digits is not None else e).alias(n) for n, e in rates.items()]
    return counts.select(*groups, "tp", "tn", "fp", "fn", "n_test", *shown)


def auc(scored: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Exact area under the ROC curve per group (tied scores count half).

    Rows are merged per score; legitimate rows with a smaller score come from split running totals, so no
    model is ranked in a single task.
    """
    marked = scored.select(*groups, "prob", (F.col("label") == 1).cast("bigint").alias("pos"), (F.col("label") == 0).cast("bigint").alias("neg"))
    totals = running_totals(marked, list(groups), "prob", ["pos", "neg"])
    wins = totals.groupBy(*groups).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("_wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return wins.select(*groups, "n_pos", "n_neg", F.round(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_wins") / (
        F.col("n_pos").cast("double") * F.col("n_neg"))), 6).alias("auc_roc"))


def evaluate(scored: DataFrame, groups: Sequence[str] = ("model",), threshold: float = L.PREDICT_THRESHOLD) -> DataFrame:
    """All fourteen fields of the metrics record per group."""
    return confusion_metrics(scored, groups, threshold).join(auc(scored, groups).select(*groups, "auc_roc"), list(groups)) \
        .withColumn("threshold", F.lit(threshold))


def compare_models(metrics: DataFrame) -> DataFrame:
    """Models by F1, best first (one row per model)."""
    best = Window.orderBy(F.desc("f1"), "model")
    return metrics.select("model", "f1", F.row_number().over(best).alias("place"))


def metrics_by_source(scored: DataFrame, threshold: float = L.PREDICT_THRESHOLD) -> DataFrame:
    """Error counts and F1 for every source and model, and for both totals ('ALL')."""
    y, p = F.col("label") == 1, F.col("prob") >= threshold
    counts = scored.cube("source", "model").agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count("*").alias("n_test"),
        F.grouping("source").alias("_gs"), F.grouping("model").alias("_gm"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.select(
        F.when(F.col("_gs") == 1, F.lit("ALL")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("_gm") == 1, F.lit("ALL")).otherwise(F.col("model")).alias("model"), "tp", "fp", "fn", "n_test",
        F.round(F.when(den == 0, F.lit(0.0)).otherwise(2.0 * F.col("tp") / den), 6).alias("f1"))


def with_noise(df: DataFrame, columns: Sequence[str], sigmas: Sequence[float] = (0.0, 0.05, 0.1, 0.2), seed: int = 42) -> DataFrame:
    """Every row once per sigma with Gaussian noise on the columns.

    The noise comes from hashes of seed, row, column and sigma (Box-Muller), so retries give equal values.
    """
    out = df.withColumn("noise_sigma", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    share = F.round(F.col("noise_sigma") * 1e6).cast("bigint")
    digest = lambda tag, c: F.md5(F.concat_ws("|", F.lit(f"{seed}|{tag}|{c}"), F.col("mail_id").cast("string"), share.cast("string")))
    unit = lambda tag, c: (F.conv(F.substring(digest(tag, c), 1, 8), 16, 10).cast("bigint") + 1) / F.lit(4294967297.0)
    noisy = []
    for c in columns:
        z = F.sqrt(-2.0 * F.log(unit(1, c))) * F.cos(2.0 * 3.141592653589793 * unit(2, c))
        noisy.append((F.col(c).cast("double") + F.col("noise_sigma") * z).alias(c))
    return out.select(*[c for c in out.columns if c not in columns], *noisy)


def failure_modes(table: DataFrame, names: Sequence[str], threshold: float = L.PREDICT_THRESHOLD, top: int = 20) -> DataFrame:
    """Highest mean features among missed and wrongly flagged mails: ``mode, rank, feature, mean_value``.

    Means are taken per mode first; the ranking sees one row per mode and feature.
    """
    y, p = F.col("label") == 1, F.col("prob") >= threshold
    wrong = table.withColumn("mode", F.when(y & ~p, F.lit("false_negative")).when(~y & p, F.lit("false_positive"))).where("mode IS NOT NULL")
    means = long_form(wrong, names, extra=["mode"]).groupBy("mode", "feature").agg(F.round(F.avg("value"), 6).alias("mean_value"))
    order = Window.partitionBy("mode").orderBy(F.desc("mean_value"), "feature")
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def robustness(scored: DataFrame, threshold: float = L.PREDICT_THRESHOLD, target: float = 0.90) -> DataFrame:
    """Per ``attack``: clean and attacked F1, their ratio, evasion rate; and whether the mean ratio passes.

    ``scored`` holds label, prob and ``attack`` ('clean' for the unchanged mails).
    """
    m = confusion_metrics(scored, ["attack"], threshold, digits=None)
    clean = m.where("attack = 'clean'").select(F.col("f1").alias("f1_clean"))
    r = m.where("attack <> 'clean'").join(F.broadcast(clean)).select(
        "attack", "f1_clean", F.col("f1").alias("f1_adversarial"),
        F.when(F.col("f1_clean") > 0, F.col("f1") / F.col("f1_clean")).otherwise(F.lit(0.0)).alias("robustness"),
        (1.0 - (F.col("tp") + F.col("fp")) / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("evasion_rate"))
    overall = r.agg(F.avg("robustness").alias("overall_robustness"))
    return r.join(F.broadcast(overall)).select(
        "attack", *[F.round(c, 6).alias(c) for c in ("f1_clean", "f1_adversarial", "robustness", "evasion_rate", "overall_robustness")],
        (F.col("overall_robustness") >= target).alias("passed"))
