"""URL filter: fixed rules first, association rules mined from labelled URLs for the rest.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path follows up
to ``?``, ``#`` or the end. A fixed rule fits its host and all subdomains of it if the path starts with the rule's path;
the longest rule that fits decides.

For other URLs Spark's FP-growth mines combinations of URL tokens that go with a label. Rules below the support or the
confidence are pruned. A rule is listed in an inverted index under its rarest token; a URL meets the rules of its own
tokens there and takes the label of the best rule whose tokens it has all (by confidence, then support, then number of
tokens, then block before allow). Without such a rule it is allowed.

Null URLs and URLs without ``://`` have empty host and path, fit no rule and are allowed. Repeated rows get equal answers.
An empty table gives no rows, no labels give no mined rules. Other columns are ignored, URLs are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.exact import LOWER, UPPER

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"
_LABEL = "label="


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits columns host and path; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [(F.concat(F.lit("."), "host").endswith("." + r.host)) & F.col("path").startswith(r.path) for r in ordered]
    return (F.coalesce(*[F.when(f, F.lit(r.text)) for f, r in zip(fits, ordered, strict=True)]),
            F.coalesce(*[F.when(f, F.lit(r.verdict)) for f, r in zip(fits, ordered, strict=True)]))


def tokens(url: str = "url") -> Column:
    """Distinct host labels, path words and query keys, numbers as one token."""
    parts = lambda c, cut: F.filter(F.split(F.regexp_replace(c, r"[0-9]+", "0"), cut), lambda t: t != "")
    tagged = lambda tag, c: F.transform(c, lambda t: F.concat(F.lit(tag), t))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda t: F.regexp_extract(t, r"(?s)^([^=]*)", 1))
    return F.array_distinct(F.concat(tagged("h:", parts(F.col("host"), r"\.")), tagged("p:", parts(F.lower("path"), r"[/._\-]")),
                                     tagged("q:", F.filter(keys, lambda t: t != ""))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support, token) from rows with columns tokens and verdict."""
    baskets = labelled.where("verdict IS NOT NULL").select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = (model.associationRules.where(F.size("consequent") == 1).where(F.col("consequent")[0].startswith(_LABEL))
             .select("antecedent", F.substring(F.col("consequent")[0], len(_LABEL) + 1, 100).alias("verdict"), "confidence", "support"))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = rules.select("*", F.explode("antecedent").alias("token")).join(single, "token")
    return (rarest.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("token")))


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row; ``labelled`` has columns url and verdict (allow or block)."""
    rule, verdict = fixed(rules)
    parsed = lambda df, *more: df.select(*more, "url", host().alias("host"), path().alias("path")).withColumn("tokens", tokens())
    ruled = parsed(pages, "page_id").withColumn("rule", rule).withColumn("verdict", verdict)
    mined = mine(parsed(labelled, "verdict"), min_support, min_confidence)
    sets = ruled.where("rule IS NULL").select("tokens").distinct()
    hits = (sets.withColumn("token", F.explode("tokens")).join(mined, "token")
            .where(F.size(F.array_except("antecedent", "tokens")) == 0))
    best = hits.groupBy("tokens").agg(F.max_by("verdict", F.struct("confidence", "support", F.size("antecedent"), "verdict")).alias("mined"))
    other = ruled.where("rule IS NULL").join(best, "tokens", "left").withColumn("verdict", F.coalesce("mined", F.lit(DEFAULT)))
    columns = ["page_id", "url", "host", "path", "rule", "verdict"]
    return ruled.where("rule IS NOT NULL").select(*columns).unionByName(other.select(*columns))
