"""Evasive variants of raw mails. Random choices are hashes of seed, mail and position.

Variants that look at every character work on arrays of code points in Arrow tasks: as expressions they took a microsecond and more a character.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry import lists as L
from mailquarry.functions.mix import begun, picked


_SIGNS = np.array([ord(c) for c in L.ZERO_WIDTH], np.uint32)
_LOOKALIKE = np.arange(128, dtype=np.uint32)
_LOOKALIKE[[ord(c) for c in L.LOOKALIKES]] = [ord(c) for c in L.LOOKALIKES.values()]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _changed(change: Callable[..., np.ndarray], *columns: pa.Array) -> pa.Array:
    """Texts changed by their code points and the other columns; a text stays where any of them is NULL."""
    rows = zip(*(c.to_pylist() for c in columns), strict=True)
    return pa.array([r[0] if None in r else change(_points(r[0]), *r[1:]).tobytes().decode("utf-32-le") for r in rows], pa.string())


@F.arrow_udf(T.StringType())
def _signed(text: pa.Array, letters: pa.Array, picking: pa.Array, choosing: pa.Array) -> pa.Array:
    """An invisible character after about one letter in ten; ``letters`` is the text with a blank for all that is no letter."""
    def change(points: np.ndarray, letters: str, picking: int, choosing: int) -> np.ndarray:
        at = np.flatnonzero((picked(10, picking, np.arange(len(points))) == 0) & (_points(letters) != ord(" ")))
        return np.insert(points, at + 1, _SIGNS[picked(len(_SIGNS), choosing, at)])

    return _changed(change, text, letters, picking, choosing)


@F.arrow_udf(T.StringType())
def _likened(text: pa.Array, picking: pa.Array) -> pa.Array:
    """A look-alike for about one letter in five that has one."""
    def change(points: np.ndarray, picking: int) -> np.ndarray:
        at = np.flatnonzero((picked(5, picking, np.arange(len(points))) == 0) & (points < len(_LOOKALIKE)))
        points = points.copy()
        points[at] = _LOOKALIKE[points[at]]
        return points

    return _changed(change, text, picking)


def zero_width(raw: Column, mail_id: Column, seed: int = 42) -> Column:
    """After about one body letter in ten an invisible character."""
    at = F.locate("\n\n", raw)
    body = F.substr(raw, at + 2)
    spread = _signed(body, F.regexp_replace(body, r"\P{L}", " "), *[begun(F.lit(seed), F.lit(k), mail_id) for k in (1, 2)])
    return F.when(at == 0, raw).otherwise(F.concat(F.substring_index(raw, "\n\n", 1), F.lit("\n\n"), spread))


def lookalikes(raw: Column, mail_id: Column, seed: int = 42) -> Column:
    """About one in five letters that has a look-alike is replaced by it."""
    return _likened(raw, begun(F.lit(seed), F.lit(3), mail_id))


def redirect(raw: Column, mail_id: Column, seed: int = 42) -> Column:
    """Every link behind a redirector; the redirector is chosen per mail."""
    n = F.pmod(mail_id + F.lit(seed), F.lit(len(L.REDIRECTORS)))
    out = raw
    for i, r in enumerate(L.REDIRECTORS):
        out = F.when(n == i, F.regexp_replace(raw, r"""(https?://[^\s<>"']+)""", f"{r}$1")).otherwise(out)
    return out


ATTACKS = ["whitespace_insertion", "homoglyph_substitution", "url_obfuscation", "urgency_dilution", "brand_mutation"]


def _edits(attack: str, seed: int) -> list[tuple[str, Column, bool]]:
    """(text to find, replacement, ignore case) for the attacks that edit first occurrences."""
    if attack == "urgency_dilution":        # a calming sentence after each urgency word
        n = F.pmod(F.col("mail_id") + F.lit(seed), F.lit(len(L.URGENCY_FILLERS)))
        sentence = F.element_at(F.array(*[F.lit(s) for s in L.URGENCY_FILLERS]), (n + 1).cast("int"))
        return [(w, F.concat(F.lit(w), sentence), True) for w in L.URGENCY_WORDS]
    mid = lambda b: len(b) // 2             # a zero-width space inside each brand
    return [(b, F.lit(b[:mid(b)] + L.ZERO_WIDTH[0] + b[mid(b):]), False) for b in L.VARIANT_BRANDS]


def apply(mails: DataFrame, attack: str, seed: int = 42) -> DataFrame:
    """The mails with ``raw_email`` changed by one attack.

    Chained edits become one projection each, so no text is copied into a nested expression.
    """
    raw, mail_id = F.col("raw_email"), F.col("mail_id")
    whole = {"whitespace_insertion": zero_width, "homoglyph_substitution": lookalikes, "url_obfuscation": redirect}
    if attack in whole:
        return mails.withColumn("raw_email", whole[attack](raw, mail_id, seed))
    others = [c for c in mails.columns if c != "raw_email"]
    for find, new, fold in _edits(attack, seed):
        at = F.locate(find, F.lower(raw) if fold else raw)
        mails = mails.select(*others, raw, at.alias("_at"))
        edited = F.concat(F.substring(raw, F.lit(1), F.col("_at") - 1), new, F.substring(raw, F.col("_at") + len(find), F.length(raw)))
        mails = mails.select(*others, F.when(F.col("_at") > 0, edited).otherwise(raw).alias("raw_email"))
    return mails


def all_variants(mails: DataFrame, seed: int = 42) -> DataFrame:
    """The clean mails and every variant, told apart by ``attack``."""
    frames = [mails.withColumn("attack", F.lit("clean"))]
    frames += [apply(mails, a, seed).withColumn("attack", F.lit(a)) for a in ATTACKS]
    return reduce(lambda x, y: x.unionByName(y), frames)
