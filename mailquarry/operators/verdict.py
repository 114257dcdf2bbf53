"""Verdicts: from the model alone, and combined with services, stored AI answers and authentication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import text as X
from mailquarry.operators.reputation import TOOLS, one_per_key

AI_SCHEMA = ("is_phishing BOOLEAN, confidence DOUBLE, risk_level STRING, impersonated_brand STRING, "
             "phishing_signals ARRAY<STRING>, explanation STRING, recommended_action STRING")


def ml_verdict(prob: Column, phishing: float = L.PHISHING_THRESHOLD, uncertain: float = L.UNCERTAIN_THRESHOLD) -> Column:
    return (F.when(prob >= phishing, F.lit("PHISHING")).when(prob >= uncertain, F.lit("UNCERTAIN"))
            .otherwise(F.lit("LEGITIMATE")))


def ai_answers(mails: DataFrame, answers: DataFrame) -> DataFrame:
    """Join stored JSON answers ``(mail_id, answer)``; missing or broken answers give the defaults.

    Of several answers for a mail the last in text order counts.
    """
    valid = F.col("a").isNotNull() & F.coalesce(F.col("_ok"), F.lit(False))
    parsed = one_per_key(answers.select("mail_id", "answer"), "mail_id").select("mail_id", F.from_json("answer", AI_SCHEMA).alias("a"),
                            F.expr("try_parse_json(answer) IS NOT NULL").alias("_ok"))
    out = mails.join(parsed, "mail_id", "left")
    pick = lambda field, default_in, default_out: F.when(valid, F.coalesce(F.col(f"a.{field}"), default_in)).otherwise(default_out)
    return out.select(
        *mails.columns,
        F.when(valid, F.coalesce(F.col("a.is_phishing"), F.lit(False)).cast("int")).otherwise(F.lit(-1)).alias("ai_is_phishing"),
        pick("confidence", F.lit(0.0), F.lit(-1.0)).alias("ai_confidence"),
        pick("risk_level", F.lit("LOW"), F.lit("UNKNOWN")).alias("ai_risk_level"),
        F.when(valid, F.col("a.impersonated_brand")).alias("ai_brand"),
        F.when(valid, F.coalesce(F.size("a.phishing_signals"), F.lit(0))).otherwise(F.lit(0)).alias("ai_n_signals"),
        pick("recommended_action", F.lit("MONITOR"), F.lit("MONITOR")).alias("ai_action"))


def composite_verdict(df: DataFrame, threshold: float = L.PHISHING_THRESHOLD, uncertain: float = L.UNCERTAIN_THRESHOLD) -> DataFrame:
    """Add ``adjusted_prob``, ``verdict`` and ``reasons``.

    Needs ``prob``, ``ai_is_phishing``, ``ai_confidence``, the six ``*_verdict`` columns and
    ``hdr_spf_result``, ``hdr_dkim_result``, ``hdr_dmarc_result``.
    """
    c, lit = F.col, F.lit
    tools = [c(f"{t}_verdict") for t in TOOLS]
    count = lambda v: sum(((t == v).cast("int") for t in tools), lit(0))
    auth = [c(f"hdr_{k}_result") for k in ("spf", "dkim", "dmarc")]
    df = df.select(
        "*", count("MALICIOUS").alias("_bad"), count("SUSPICIOUS").alias("_odd"), count("CLEAN").alias("_ok"),
        sum(((a < 0).cast("int") for a in auth), lit(0)).alias("_fails"),
        sum(((a > 0).cast("int") for a in auth), lit(0)).alias("_passes"),
        ((c("ai_is_phishing") == 1) & (c("ai_confidence") >= 0.65)).alias("_ai_bad"),
        ((c("ai_is_phishing") == 0) & (c("ai_confidence") >= 0.80)).alias("_ai_ok"))
    prob, conf = c("prob"), c("ai_confidence")
    df = df.withColumn("_a", F.when(c("_ai_bad"), F.greatest(prob, prob + conf * 0.25))
                       .when(c("_ai_ok"), F.least(prob, prob - conf * 0.15)).otherwise(prob))
    df = df.withColumn("_a", F.when(c("_bad") >= 1, F.greatest(c("_a"), lit(threshold) + 0.05 + F.least(lit(0.40), lit(0.20) * c("_bad")))).otherwise(c("_a")))
    df = df.withColumn("_a", F.when(c("_odd") >= 2, F.greatest(c("_a"), lit(threshold) - 0.01)).otherwise(c("_a")))
    df = df.withColumn("_consensus", (c("_ok") >= 3) & (c("_bad") == 0) & (c("_a") < threshold))
    df = df.withColumn("_a", F.when(c("_consensus"), F.least(c("_a"), lit(uncertain) - (lit(0.05) + lit(0.02) * F.greatest(lit(0), c("_ok") - 3)))).otherwise(c("_a")))
    trusted = (c("vt_verdict") != "MALICIOUS") & (c("gsb_verdict") != "MALICIOUS")
    df = df.withColumn("_auth_ok", (c("_fails") < 2) & (c("_passes") >= 2) & (c("_a") < threshold) & trusted)
    df = df.withColumn("_a", F.when(c("_fails") >= 2, F.greatest(c("_a"), prob + lit(0.08) * c("_fails")))
                       .when(c("_auth_ok"), F.least(c("_a"), prob - lit(0.04) * c("_passes"))).otherwise(c("_a")))
    df = df.withColumn("adjusted_prob", F.greatest(lit(0.0), F.least(lit(1.0), F.round("_a", 9))))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else lit(p) for p in parts])
    reasons = F.array_compact(F.array(
        F.when(c("_ai_bad"), text("AI: PHISHING ", X.percent(conf))),
        F.when(c("_ai_ok"), text("AI: LEGITIMATE ", X.percent(conf))),
        *[F.when(c(f"{t}_verdict") == "MALICIOUS", lit(f"TI: {t.upper()} MALICIOUS")) for t in TOOLS],
        F.when(c("_odd") >= 2, text("TI: ", c("_odd").cast("string"), " SUSPICIOUS")),
        F.when(c("_consensus"), text("TI: ", c("_ok").cast("string"), " CLEAN")),
        F.when(c("_fails") >= 2, text("Auth: ", c("_fails").cast("string"), " failed"))
        .when(c("_auth_ok"), text("Auth: ", c("_passes").cast("string"), " passed"))))
    out = df.withColumn("reasons", reasons).withColumn("verdict", ml_verdict(c("adjusted_prob"), threshold, uncertain))
    return out.drop("_bad", "_odd", "_ok", "_fails", "_passes", "_ai_bad", "_ai_ok", "_a", "_consensus", "_auth_ok")
