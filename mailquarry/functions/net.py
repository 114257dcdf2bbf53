"""Expressions over URLs, hosts, addresses and IPs.

The staged form lets the same definitions run over a table of URLs (one projection per stage) and
inside an array column (one ``transform`` per stage), so a mail's links are analysed without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import text as X

Stage = Callable[[Callable[[str], Column]], dict[str, Column]]

IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
IPV4_WORD = rf"\b{IPV4}\b"
URL_IN_TEXT = f"(?i)https?://[^{X.SPACE}<>\"'(){{}}\\[\\]]+"
URL_IN_BODY = f"(?i)https?://[^{X.SPACE}<>\"'()\\[\\]]+"
ADDRESS = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


def run_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Add the columns of each stage, one projection per stage."""
    for stage in stages:
        new = stage(F.col)
        keep = [F.col(c) for c in df.columns if c not in new]
        df = df.select(*keep, *[e.alias(n) for n, e in new.items()])
    return df


def _struct_step(stage: Stage, names: list[str]) -> tuple[Callable[[Column], Column], list[str]]:
    added: list[str] = []

    def step(s: Column) -> Column:
        new = stage(lambda n: s[n])
        added.extend(n for n in new if n not in added)
        return F.struct(*[s[n].alias(n) for n in names if n not in new], *[e.alias(n) for n, e in new.items()])

    return step, added


def stage_structs(structs: Column, names: list[str], stages: Sequence[Stage]) -> tuple[Column, list[str]]:
    """The same over an array of structs with the given field names; returns the array and its names."""
    for stage in stages:
        step, added = _struct_step(stage, names)
        structs = F.transform(structs, step)
        names = [n for n in names if n not in added] + added
    return structs, names


def run_stages_in_array(urls: Column, first: str, stages: Sequence[Stage]) -> Column:
    """The same over an array of strings; the result is an array of structs."""
    return stage_structs(F.transform(urls, lambda u: F.struct(u.alias(first))), [first], stages)[0]


# --- URL parts ----------------------------------------------------------------------------

def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def host_of_netloc(n: Column) -> Column:
    """Lower-case host without user part and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(n, "^.*@", ""), ":[0-9]*$", ""))


def port_of_netloc(n: Column) -> Column:
    return F.regexp_extract(n, ":([0-9]+)$", 1).try_cast("int")


def query_param(q: Column, name: str) -> Column:
    """First non-blank value of a query parameter, decoded once; NULL if absent."""
    raw = F.nullif(F.regexp_extract(q, f"(?:^|&){name}=([^&]+)", 1), F.lit(""))
    return X.unquote(F.replace(raw, F.lit("+"), F.lit(" ")))


def is_http(c: Column) -> Column:
    return F.startswith(c, F.lit("http://")) | F.startswith(c, F.lit("https://"))


# --- registered domain --------------------------------------------------------------------

BUCKETS = 4096              # of the table of suffix rules; a bucket holds about two


@cache
def _rule_table(rules: frozenset[str]) -> tuple[str, int]:
    """The rules dealt to buckets by the CRC-32 of their name, as one text; and the labels of the longest."""
    buckets = [""] * BUCKETS
    for rule in sorted(rules):
        kind = rule[0] if rule[0] in "!*" else "="
        name = rule.lstrip("!*.") if kind != "=" else rule
        at = zlib.crc32(name.encode()) % BUCKETS
        buckets[at] += ("" if buckets[at] else "\1") + f"{kind}{name}\1"
    return "\2".join(buckets), max((r.count(".") + 1 for r in rules), default=0)


def suffix(host: Column, suffixes: Iterable[str] | None = None) -> Column:
    """Longest public suffix of a host, '' when no rule fits or when the host is an address.

    Rules are those of the public-suffix list: ``*.ck`` makes every name under ck a suffix, ``!www.ck`` excepts one.
    The rules are a hash table in one literal array: each tail of the host is looked up in the bucket of its CRC-32, so
    the cost of a host does not depend on the number of rules, and the test needs neither a join nor a shuffle.
    """
    text, most = _rule_table(frozenset(L.SUFFIXES if suffixes is None else suffixes))
    if not most:
        return F.lit("")
    tail = lambda size: F.call_function("substring_index", host, F.lit("."), -size)
    table = F.split(F.lit(text), "\2")                  # folded by the optimizer; it stands in the plan once
    own = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    names = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), own)), tail)
    buckets = F.transform(names, lambda t: F.get(table, F.crc32(t.cast("binary")) % BUCKETS))

    def labels(bucket: Column, place: Column) -> Column:
        """Labels of the suffix by the rules of one tail; those of an exception stand above all others."""
        t = tail(place + 1)
        has = lambda kind: F.contains(bucket, F.concat(F.lit(f"\1{kind}"), t, F.lit("\1")))
        return (F.when(has("!"), place + 1000).when(has("*") & (t != host), place + 2)
                .when(has("="), place + 1).otherwise(0))

    most_labels = F.array_max(F.transform(buckets, labels))
    found = F.transform(F.array(most_labels), lambda n: F.when(n == 0, F.lit("")).otherwise(tail(n % 1000)))[0]
    return F.when(host.rlike(f"^{IPV4}$"), F.lit("")).otherwise(found)


def domain_label(host: Column, sfx: Column) -> Column:
    """The label in front of the suffix (the last label when there is no suffix)."""
    rest = F.when(sfx == "", host).when(host == sfx, F.lit("")).otherwise(
        F.substring(host, F.lit(1), F.length(host) - F.length(sfx) - 1))
    return F.when(host.rlike(f"^{IPV4}$"), host).otherwise(F.substring_index(rest, ".", -1))


def registered(host: Column, sfx: Column) -> Column:
    label = domain_label(host, sfx)
    return F.when((sfx != "") & (label != ""), F.concat(label, F.lit("."), sfx)).otherwise(F.lit(""))


def subdomain(host: Column, sfx: Column) -> Column:
    """Everything in front of the registered domain."""
    tail = F.length(domain_label(host, sfx)) + F.when(sfx == "", F.lit(0)).otherwise(F.length(sfx) + 1)
    size = F.greatest(F.length(host) - tail - 1, F.lit(0))
    return F.when(host == sfx, F.lit("")).otherwise(F.substring(host, F.lit(1), size))


def registered_domain(host: Column, suffixes: Iterable[str] | None = None) -> Column:
    return F.transform(F.array(suffix(host, suffixes)), lambda sfx: registered(host, sfx))[0]         # the suffix is computed once


def domain_stages(url: str = "url", suffixes: Iterable[str] | None = None) -> list[Stage]:
    """netloc, host, suffix, then registered domain, label and subdomain."""
    return [
        lambda g: {"netloc": netloc(g(url))},
        lambda g: {"host": host_of_netloc(g("netloc"))},
        lambda g: {"suffix": suffix(g("host"), suffixes)},
        lambda g: {
            "label": domain_label(g("host"), g("suffix")),
            "domain": registered(g("host"), g("suffix")),
            "subdomain": subdomain(g("host"), g("suffix")),
        },
    ]


# --- addresses and IPs --------------------------------------------------------------------

def address_domain(c: Column) -> Column:
    """Domain of an address or of a bare domain; '' when there is none."""
    inside = F.regexp_extract(c, r"[a-zA-Z0-9_.+\-]+@([a-zA-Z0-9_.\-]+\.[a-zA-Z]{2,})", 1)
    bare = F.regexp_extract(X.strip(c), r"^([a-zA-Z0-9_.\-]+\.[a-zA-Z]{2,})$", 1)
    return F.when(inside != "", inside).otherwise(bare)


def ips_in(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IPV4_WORD), F.lit(0))


def is_private_ip(c: Column, prefixes: Iterable[str] = L.PRIVATE_PREFIXES_INDICATOR) -> Column:
    alternatives = "|".join(p.replace(".", r"\.") for p in prefixes)
    return c.rlike(f"^(?:{alternatives})")
