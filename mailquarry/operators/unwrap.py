"""Recover the real target of wrapped links.

One pass tries eight rules in order; up to six passes follow nested wrappers. Work on distinct URLs and
join back. Targets that only a server knows come from a table of observed redirects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import net
from mailquarry.functions import text as X
from mailquarry.operators.reputation import lookup_join

MAX_PASSES = 6
_SAFELINKS = r"(?i)^https?://[a-z0-9\-]+\.safelinks\.protection\.outlook\.com/"
_MIMECAST = r"(?i)^https?://protect(?:-[a-z0-9]+)?\.mimecast\.com/s/"
_BARRACUDA = r"(?i)^https?://links\.barracudanetworks\.com/"


def _http_or_null(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "(?s)^(https?://.*)$", 1), F.lit(""))


def _parts(g) -> dict[str, Column]:
    u = g("current")
    return {"_host": F.lower(net.netloc(u)), "_path": net.path(u), "_query": net.query(u)}


def _candidates(g) -> dict[str, Column]:
    """Targets of all rules in order, NULL where a rule does not apply."""
    u, host, path, query = g("current"), g("_host"), g("_path"), g("_query")
    arg = lambda name: net.query_param(query, name)
    defense = F.contains(host, F.lit("urldefense.com")) | F.contains(host, F.lit("urldefense.proofpoint.com"))
    v3_path = F.contains(path, F.lit("/v3/__"))
    hexed = X.unquote(F.regexp_replace(arg("u"), "-([0-9A-Fa-f]{2})", "%$1"))
    rules = [
        (u.rlike(_SAFELINKS), _http_or_null(X.unquote(X.unquote(X.unquote(arg("url"))))), L.METHOD_SAFELINKS),
        (defense & v3_path, _http_or_null(X.unquote(F.regexp_extract(u, r"/v3/__(.+?)__(?:;|$)", 1))), L.METHOD_PP_V3),
        (defense & ~v3_path & F.contains(path, F.lit("/v2/url")),
         _http_or_null(X.unquote(F.regexp_replace(hexed, "^(.*?)__", "$1//"))), L.METHOD_PP_V2),
        (F.contains(host, F.lit("google.com")) & path.isin("/url", "/url/"),
         F.nullif(X.unquote(F.coalesce(arg("q"), arg("url"))), F.lit("")), L.METHOD_GOOGLE),
        (u.rlike(_BARRACUDA), F.coalesce(*[X.unquote(_http_or_null(arg(p))) for p in ("url", "u", "dest")]), L.METHOD_BARRACUDA),
        *[(F.contains(query, F.lit(f"{p}=")), X.unquote(_http_or_null(arg(p))), f"Redirect param (?{p}=)") for p in L.REDIRECT_PARAMS],
        (F.contains(u, F.lit("%")), _http_or_null(X.unquote(u)), L.METHOD_PERCENT),
    ]
    return {"_targets": F.array(*[F.struct(F.when(cond, target).alias("target"), F.lit(m).alias("method")) for cond, target, m in rules])}


def _rules(g) -> dict[str, Column]:
    """The first rule with a target; generic parameters must lead to another host."""
    u, host = g("current"), g("_host")

    def usable(t: Column) -> Column:
        other = F.lower(net.netloc(t["target"]))
        generic = F.startswith(t["method"], F.lit("Redirect param"))
        percent = t["method"] == L.METHOD_PERCENT
        return t["target"].isNotNull() & (~generic | ((other != "") & (other != host))) & (~percent | (t["target"] != u))

    return {"_hit": F.get(F.filter(g("_targets"), usable), F.lit(0))}


def _apply(g) -> dict[str, Column]:
    hit, current = g("_hit"), g("current")
    changed = F.coalesce(hit["target"] != current, F.lit(False))
    return {
        "current": F.when(changed, hit["target"]).otherwise(current),
        "method": F.when(changed, hit["method"]).otherwise(g("method")),
        "was_wrapped": g("was_wrapped") | changed,
    }


FIND = [_parts, _candidates, _rules]


def _gateway(g) -> Column:
    return g("current").rlike(_MIMECAST) | g("current").rlike(_BARRACUDA)


def _opaque(g) -> Column:
    """Links whose target a redirect look-up may give (the shape of rules 4, 5 and 8)."""
    host = g("_host")
    return _gateway(g) | F.regexp_replace(host, r"^www\.", "").isin(L.REDIRECT_HOSTS) | host.isin(L.REDIRECT_HOSTS)


def _redirect_method(g) -> Column:
    u = g("current")
    return (F.when(u.rlike(_MIMECAST), F.lit(L.METHOD_MIMECAST)).when(u.rlike(_BARRACUDA), F.lit(L.METHOD_BARRACUDA))
            .otherwise(F.lit(L.METHOD_SHORTENER)))


def _begin(url: Column) -> dict[str, Column]:
    return {"current": X.strip(url), "method": F.lit(L.METHOD_NONE), "was_wrapped": F.lit(False)}


def _finish(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns, F.col("current").alias("cleaned"), "method", "was_wrapped")


def cleaned_in_array(urls: Column, passes: int = MAX_PASSES) -> Column:
    """Unwrap an array of links: array of ``url, current, method, was_wrapped``.

    The passes are a fold over a constant range, so the expression holds one pass, not six copies.
    """
    fields = ["url", "current", "method", "was_wrapped"]
    first = F.transform(urls, lambda u: F.struct(u.alias("url"), *[e.alias(n) for n, e in _begin(u).items()]))

    def one_pass(links: Column) -> Column:
        out, _ = net.stage_structs(links, fields, [*FIND, _apply])
        return F.transform(out, lambda s: F.struct(*[s[n].alias(n) for n in fields]))

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), first, lambda acc, _: one_pass(acc))


def clean_urls(urls: DataFrame, redirects: DataFrame | None = None, passes: int = MAX_PASSES) -> DataFrame:
    """Unwrap to the end: ``cleaned, method, was_wrapped`` per URL (feed distinct URLs).

    With ``redirects(url, location)`` every pass may also follow one observed redirect. Its rows are
    reduced to one per URL; only HTTP targets count.
    """
    columns = urls.columns
    if redirects is None:
        one = F.get(cleaned_in_array(F.array("url"), passes), F.lit(0))
        return urls.withColumn("_c", one).select(
            *columns, F.col("_c.current").alias("cleaned"), F.col("_c.method").alias("method"), F.col("_c.was_wrapped").alias("was_wrapped"))
    usable = (redirects.where(F.col("location").rlike("^https?://")).groupBy("url").agg(F.min("location").alias("_location"))
              .withColumnRenamed("url", "current"))
    df = net.run_stages(urls, [lambda g: _begin(g("url"))])
    for _ in range(passes):
        df = lookup_join(net.run_stages(df, FIND), usable, "current", spread="current")
        follow = F.struct(F.col("_location").alias("target"), _redirect_method(F.col).alias("method"))
        # A gateway link asks the server before the generic parameters are tried, a shortener after.
        before = F.col("_hit").isNull() | (_gateway(F.col) & ~F.col("_hit.method").isin(
            L.METHOD_SAFELINKS, L.METHOD_PP_V3, L.METHOD_PP_V2, L.METHOD_GOOGLE, L.METHOD_BARRACUDA))
        use = _opaque(F.col) & F.col("_location").isNotNull() & before
        df = df.withColumn("_hit", F.when(use, follow).otherwise(F.col("_hit"))).drop("_location")
        df = net.run_stages(df, [_apply]).select(*columns, "current", "method", "was_wrapped")
    return _finish(df, columns)


def single_pass(urls: DataFrame) -> DataFrame:
    """One unwrapping pass: ``cleaned, method, was_wrapped`` per URL."""
    return clean_urls(urls, passes=1)


def cleaning_summary(cleaned: DataFrame, width: int | None = None) -> DataFrame:
    """One readable line per wrapped URL; ``width`` shortens the links shown."""
    def short(c: str) -> Column:
        if width is None:
            return F.col(c)
        return F.concat(F.substring(c, 1, width), F.when(F.length(c) > width, F.lit("…")).otherwise(F.lit("")))

    line = F.concat(F.lit("["), F.col("method"), F.lit("] "), short("url"), F.lit("\n  → Real destination: "), short("cleaned"))
    return cleaned.where("was_wrapped").select("url", line.alias("line"))
