"""Text expressions built from JVM-side functions only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks that separate words: ASCII blanks plus the Unicode spaces.
SPACE = r"\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The same characters as a plain string.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Remove blanks of every kind at both ends (only the ends are looked at)."""
    return F.btrim(c, F.lit(BLANKS))


def blank_to_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), F.lit(0))


# Blanks that \s of the JVM does not know.
_RARE = BLANKS.translate({ord(b): None for b in "\t\n\x0b\f\r "})


def word_count(c: Column) -> Column:
    """Runs of characters other than blanks; the rare blanks are mapped first, so that the pattern stays a plain class."""
    return F.regexp_count(F.translate(c, _RARE, " " * len(_RARE)), F.lit(r"\S++"))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words and, if there are more, the rest of the text as one more."""
    return F.split(strip(F.translate(c, _RARE, " " * len(_RARE))), r"\s+", n + 1)


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for cond in conditions:
        out = out | cond
    return out


def contains_any(c: Column, values: Iterable[str]) -> Column:
    """True if one of the literals occurs in ``c`` (one regular expression, ``c`` is read once)."""
    return c.rlike("|".join(re.escape(v) for v in values))


def count_present(c: Column, values: Iterable[str]) -> Column:
    """How many of the literals occur in ``c``."""
    total = F.lit(0)
    for v in values:
        total = total + F.contains(c, F.lit(v)).cast("int")
    return total


def first_present(c: Column, values: Iterable[str]) -> Column:
    """The first literal, in list order, that occurs in the column ``c``; NULL if none does."""
    return F.get(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: F.contains(c, v)), F.lit(0))


def unquote(c: Column) -> Column:
    """Percent-decoding that leaves ``+`` and broken escapes alone; ``c`` appears once in the expression."""
    guarded = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B")))


def entropy(c: Column) -> Column:
    """Shannon entropy, in bits, of the characters of ``c``."""
    n = F.length(c).cast("double")

    def add(acc: Column, ch: Column) -> Column:
        p = (F.length(c) - F.length(F.replace(c, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    chars = F.array_distinct(F.filter(F.split(c, ""), lambda ch: ch != ""))
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), add))


def _accent_table() -> tuple[str, str]:
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        flat = "".join(ch for ch in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(ch))
        if len(flat) == 1 and flat != chr(cp):
            src.append(chr(cp))
            dst.append(flat)
    return "".join(src), "".join(dst)


ACCENTS = _accent_table()


def strip_accents(c: Column) -> Column:
    """Replace accented Latin letters by their base letters."""
    return F.translate(c, *ACCENTS)


def refang(c: Column) -> Column:
    """Undo analyst-style defanging: [://], hxxp, [.], (.) and [].

    The separator comes first, so that ``hxxp[://]`` is recognised as well.
    """
    c = F.replace(c, F.lit("[://]"), F.lit("://"))
    c = F.regexp_replace(c, "(?i)hxxp(s?)://", "http$1://")
    return F.regexp_replace(c, r"\[\.?\]|\(\.\)", ".")


def percent(c: Column, digits: int = 0) -> Column:
    """A ratio as a percentage text; ties go to the even digit."""
    return F.concat(F.format_string(f"%.{digits}f", F.bround(c * 100, digits)), F.lit("%"))
