"""Column discovery, label normalisation, text clean-up and simple predicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import text as X


def find_column(columns: Sequence[str], candidates: Iterable[str], substring: bool = False) -> str | None:
    """First candidate that names a column, names compared trimmed and in lower case.

    In substring mode a column matches when it contains the candidate.
    """
    folded = {}
    for c in columns:
        folded.setdefault(c.strip().lower(), c)
    for cand in candidates:
        if cand in folded:
            return folded[cand]
    if substring:
        for cand in candidates:
            for name, original in folded.items():
                if cand in name:
                    return original
    return None


def label_strict(c: Column) -> Column:
    """0 or 1 for the known spellings, NULL otherwise."""
    key = F.lower(X.strip(c.cast("string")))
    zeros = [k for k, v in L.LABELS_STRICT.items() if v == 0]
    ones = [k for k, v in L.LABELS_STRICT.items() if v == 1]
    return F.when(key.isin(zeros), F.lit(0)).when(key.isin(ones), F.lit(1))


def label_three_class(c: Column) -> Column:
    """ham / phish / spam to 0 / 1 / 1, NULL when unknown."""
    text = F.lower(X.strip(c.cast("string")))
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))
    return (F.when(number == 0, F.lit(0)).when(number.isin(1, 2), F.lit(1))
            .when(number.isNotNull(), F.lit(None).cast("int"))
            .when(text.isin(L.LABELS_THREE_CLASS_0), F.lit(0))
            .when(text.isin(L.LABELS_THREE_CLASS_1), F.lit(1)))


def label_lenient(c: Column) -> Column:
    """1 for the phishing spellings and for numbers that truncate to 1, 0 for everything else."""
    text = X.strip(F.coalesce(c.cast("string"), F.lit("")))
    number = text.try_cast("double")
    one = text.isin(L.LABELS_LENIENT_PHISHING) | F.coalesce((number >= 1) & (number < 2), F.lit(False))
    return F.when(one, F.lit(1)).otherwise(F.lit(0))


LABEL_MODES = {"strict": label_strict, "three_class": label_three_class, "lenient": label_lenient}


def drop_blank(df: DataFrame, text: str = "raw_email") -> DataFrame:
    """NULL text becomes '', rows with blank text go."""
    return df.withColumn(text, X.blank_to_empty(F.col(text))).where(X.strip(F.col(text)) != "")


def min_length(df: DataFrame, n: int, text: str = "raw_email") -> DataFrame:
    return df.where(F.length(X.strip(F.col(text))) >= n)


def binary_only(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isin(0, 1))


def cap_text(c: Column, chars: int | None) -> Column:
    """First ``chars`` characters; the whole text for None."""
    return c if chars is None else F.substring(c, 1, chars)


def to_corpus(df: DataFrame, source: str, *, labels: Iterable[str] = L.LABEL_COLUMNS,
              texts: Iterable[str] = L.TEXT_COLUMNS, mode: str = "strict", substring: bool = False,
              default_label: int | None = None, label_if_missing: int | None = None) -> DataFrame | None:
    """Project any frame to ``label, raw_email, source``; None when no text or label column is found.

    ``default_label`` replaces unknown label values, ``label_if_missing`` is used when the frame has no
    label column at all.
    """
    label_col = find_column(df.columns, labels, substring)
    text_col = find_column(df.columns, texts, substring)
    if text_col is None or (label_col is None and label_if_missing is None):
        return None
    label = F.lit(label_if_missing) if label_col is None else LABEL_MODES[mode](F.col(f"`{label_col}`"))
    if default_label is not None:
        label = F.coalesce(label, F.lit(default_label))
    out = df.select(label.cast("int").alias("label"), F.col(f"`{text_col}`").cast("string").alias("raw_email"),
                    F.lit(source).alias("source"))
    return drop_blank(binary_only(out))


def zero_if_not_finite(c: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    c = c.cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)
