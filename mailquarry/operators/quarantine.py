"""Rows that a parse job cannot read in full: a second output beside the good rows.

Faults are found in the pass that parses, by forms that give NULL instead of an error, and kept as an array in the row. One
written table then serves both outputs, so nothing is read or parsed twice, and a row is in the good or in the failed part, never lost.
A failed row still has its columns, with the usual defaults, in the flagged table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mailquarry.functions import text as X
from mailquarry.operators import clean
from mailquarry.operators.mail import parse_mail

INPUT, HEADER, MIME, LINK, LABEL = STAGES = ("input", "header", "mime", "link", "label")
FAULTS = "array<struct<stage:string,reason:string>>"


def readable_date(value: Column) -> Column:
    """Whether a date header can be read; the name of the day, comments and named zones are not looked at."""
    bare = F.regexp_replace(F.regexp_replace(value, r"\([^)]*\)", ""), r"^\s*[A-Za-z]+,\s*", "")
    plain = F.regexp_replace(X.strip(F.regexp_replace(bare, r"\s+", " ")), "[A-Za-z]{1,5}$", "+0000")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")]).isNotNull()


def _fault(condition: Column, stage: str, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.struct(F.lit(stage).alias("stage"), reason.alias("reason")))).otherwise(F.array().cast(FAULTS))


def with_faults(raw: DataFrame, label: str | None = None) -> DataFrame:
    """Parsed mails (see :func:`mail.parse_mail`) with ``faults``, an array of stage and reason that is empty for good rows.

    ``label`` names a column whose spelling must be known; NULL is a missing label and no fault.
    """
    parsed = parse_mail(raw, broken_parts=True)
    empty = X.strip(F.coalesce("raw_email", F.lit(""))) == ""
    found = [_fault(F.col("mail_id").isNull(), INPUT, "no id"),
             _fault(empty, INPUT, "no text"),
             _fault(~F.is_valid_utf8("raw_email"), INPUT, "not UTF-8"),
             _fault((F.col("date") != "") & ~readable_date(F.col("date")), HEADER, F.concat(F.lit("unreadable date: "), F.col("date"))),
             F.transform("broken_parts", lambda p: F.struct(F.lit(MIME).alias("stage"), F.concat(F.lit("part "), p["part_no"].cast("string"), F.lit(" can't be decoded: "), p["mime"]).alias("reason"))),
             F.transform(F.filter("urls", lambda u: u.rlike("(?i)^https?:(?:/*$|///|//[/?#])")), lambda u: F.struct(F.lit(LINK).alias("stage"), F.concat(F.lit("no host: "), u).alias("reason")))]
    if label is not None:
        found.append(_fault(F.col(label).isNotNull() & clean.label_strict(F.col(label)).isNull(), LABEL, F.concat(F.lit("unknown label: "), F.col(label).cast("string"))))
    known = [F.coalesce(f, F.array().cast(FAULTS)) for f in found]
    return parsed.withColumn("faults", F.concat(*known)).drop("broken_parts")


def counted(flagged: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows with counts that are taken as they pass: ``n_rows``, ``n_failed`` and ``n_<stage>`` (rows with a fault of that stage)."""
    seen = Observation("faults")
    stages = [F.count_if(F.array_contains("faults.stage", s)).alias(f"n_{s}") for s in STAGES]
    return flagged.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("faults") > 0).alias("n_failed"), *stages), seen


def good_rows(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.size("faults") == 0).drop("faults")


def failed_rows(flagged: DataFrame, id_col: str = "mail_id") -> DataFrame:
    """``id, stage, reason``: one row per fault."""
    return flagged.where(F.size("faults") > 0).select(id_col, F.inline("faults"))
