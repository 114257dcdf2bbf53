"""Assembly of the feature table and of the feature vector."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.operators import clean, headers, html, sparse, text, urls
from mailquarry.operators.mail import body_choice

SCALARS = ([f"hdr_{n}" for n in L.HEADER_FEATURES]
           + ["url_url_count"] + [f"url_{n}_{s}" for n in L.URL_FEATURES for s in ("max", "mean")]
           + [f"url_{n}" for n in L.URL_NETWORK_FEATURES]
           + [f"html_{n}" for n in L.HTML_FEATURES] + [f"txt_{n}" for n in L.TEXT_FEATURES])
INTEL = [f"intel_{n}" for n in L.INTEL_DEFAULTS]


def scalar_features(mail: DataFrame, suffixes: Iterable[str] | None = None, keep: Sequence[str] = ("mail_id",),
                    whois: DataFrame | None = None, cert: DataFrame | None = None,
                    intel: DataFrame | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """All named scalar features of parsed mails, or those in ``names``, one row per mail.

    The four families are chained as projections on the same row, so the mail is read once and nothing is
    shuffled. Look-up results are joined last, see :func:`with_lookups`.
    """
    carry = list(keep)
    needed = ["subject", "body_text", "body_html", "urls"]
    step = headers.header_features(mail, suffixes, keep=[*carry, *[n for n in needed if n not in carry]])
    hdr = [c for c in step.columns if c.startswith("hdr_")]
    wanted = [*SCALARS, *INTEL] if names is None else list(names)
    lexical = [n for n in L.URL_FEATURES if {f"url_{n}_max", f"url_{n}_mean"} & set(wanted)]
    step = urls.url_features(step, suffixes, keep=[*dict.fromkeys([*carry, *needed[:3], *hdr])], names=lexical)
    url = [c for c in step.columns if c.startswith("url_")]
    step = html.html_features(step, "body_html", suffixes, keep=[*dict.fromkeys([*carry, "subject", "body_text", *hdr, *url])])
    htm = [c for c in step.columns if c.startswith("html_")]
    out = text.text_features(step, "body_text", keep=tuple(dict.fromkeys([*carry, *hdr, *url, *htm])))
    return with_lookups(out, whois, cert, intel).select(*carry, *wanted)


def with_lookups(table: DataFrame, *answers: DataFrame | None) -> DataFrame:
    """Join look-up features (one row per ``mail_id`` each); missing columns and answers get the defaults.

    Join after the text columns are dropped: only narrow rows should meet the look-ups.
    """
    defaults = {**{f"url_{n}": v for n, v in L.URL_NETWORK_FEATURES.items()}, **{f"intel_{n}": v for n, v in L.INTEL_DEFAULTS.items()}}
    for a in answers:
        if a is not None:
            table = table.drop(*[c for c in a.columns if c != "mail_id"]).join(a, "mail_id", "left")
    present = set(table.columns)
    filled = [F.coalesce(F.col(n), F.lit(v)).alias(n) if n in present else F.lit(v).alias(n) for n, v in defaults.items()]
    return table.select(*[c for c in table.columns if c not in defaults], *filled)


def text_for_model() -> Column:
    """Text that feeds TF-IDF and the dense vector."""
    return body_choice()


def feature_vector(table: DataFrame, names: Sequence[str] | None = None, tfidf: str | None = None, n_terms: int = 0,
                   embedding: str | None = None, embedding_dim: int = L.EMBEDDING_DIM) -> DataFrame:
    """Adds ``features`` by :func:`sparse.feature_rows`, over all scalar features of the table by default."""
    names = list(names or [n for n in [*SCALARS, *INTEL] if n in table.columns])
    return sparse.feature_rows(table, names, embedding, embedding_dim, tfidf, n_terms)


def long_form(table: DataFrame, names: Sequence[str], id_col: str = "mail_id", extra: Sequence[str] = ()) -> DataFrame:
    """``id, feature, value`` rows; values that are not finite become 0."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), clean.zero_if_not_finite(F.col(n)).alias("value")) for n in names])
    return table.select(id_col, *extra, F.inline(pairs))


def feature_group(name: Column) -> Column:
    """Family of a feature from its prefix."""
    groups = {"hdr_": "Header", "url_": "URL", "html_": "HTML", "txt_": "Text", "tfidf_": "TF-IDF", "intel_": "Intel"}
    out = F.when(F.contains(name, F.lit("anomaly")), F.lit("Anomaly")).when(
        F.startswith(name, F.lit("emb_")), F.lit("Embedding")).otherwise(F.lit("Other"))
    for prefix, group in reversed(groups.items()):
        out = F.when(F.startswith(name, F.lit(prefix)), F.lit(group)).otherwise(out)
    return out


def feature_profile(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per family: number of values and of non-zero values."""
    return (long_form(table, names).groupBy(feature_group(F.col("feature")).alias("grp"))
            .agg(F.count("*").alias("n_values"), F.count_if(F.col("value") != 0).alias("n_nonzero")))
