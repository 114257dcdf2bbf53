"""Patterns of HTML tags with quoted values as units.

All repeats are possessive, so a text that is no tag is given up after one pass. A quote that is never
closed counts as a plain character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What follows a tag's name, up to its end.
REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|)[^>=]*+)*+>"""
OPEN = rf"<[a-zA-Z]{REST}"
ANY = rf"</?[a-zA-Z]{REST}|<[^>]*+>"
ANCHOR = rf"(?i)<a\b{REST}"
SOURCE = rf"(?i)<(?:img|iframe)\b{REST}"
LINKED = rf"(?is)<a\b{REST}.*?</a\s*>"
# One scan: comments and the insides of scripts and style sheets go, tags stay whole.
HIDDEN = rf"(?is)<!--.*?-->|(<(?:script|style)\b{REST}).*?(</(?:script|style)\s*>)|({OPEN})"
# An attribute, with or without a value.
UNIT = r"""[^\s=>"'/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+))?+"""


def without_hidden(html: Column) -> Column:
    return F.regexp_replace(html, HIDDEN, "$1$2$3")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, ANY, "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, '' when absent; text inside other values is not looked at."""
    pattern = rf"""(?i)^<(?:(?!{name}\s*=){UNIT}|[\s="'/])*+{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    return F.regexp_replace(F.regexp_extract(tag, pattern, 1), r"""^["']|["']$""", "")
