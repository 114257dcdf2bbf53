"""DuckDB building blocks: the same views and tables as the Spark side, written as SQL CTEs.

Where it is easy these take another way than the Spark operators (child tables, joins and GROUP BY in
place of arrays in a row), so that a match means something.
"""

from __future__ import annotations

from collections.abc import Iterable

from mailquarry import lists as L
from mailquarry.functions import net, tags
from mailquarry.functions import text as X
from mailquarry.operators.mail import FIELDS
from mailquarry.plans import fixtures, lookups


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(items: Iterable[str]) -> str:
    return ", ".join(lit(i) for i in items)


def any_in(c: str, items: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(i)})" for i in items) + ")"


def count_in(c: str, items: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains({c}, {lit(i)})::INT" for i in items) + ")"


def first_in(c: str, items: Iterable[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains({c}, {lit(i)}) THEN {lit(i)} END" for i in items) + ")"


def ext(c: str, pattern: str, g: int = 0) -> str:
    return f"regexp_extract({c}, {lit(pattern)}, {g})"


def every(c: str, pattern: str, g: int = 0) -> str:
    return f"regexp_extract_all({c}, {lit(pattern)}, {g})"


def sub(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, 'g')"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


def n_match(c: str, pattern: str) -> str:
    return f"len({every(c, pattern)})"


def strip(c: str) -> str:
    return sub(c, f"^[{X.SPACE}]+|[{X.SPACE}]+$", "")


def n_words(c: str) -> str:
    return n_match(c, f"[^{X.SPACE}]+")


def field(head: str, name: str) -> str:
    return strip(ext(head, rf"(?i)(?:^|\n){name}:[ \t]*([^\n]*)", 1))


def re2(pattern: str) -> str:
    """The pattern without possessive repeats."""
    return pattern.replace("*+", "*").replace("++", "+").replace("?+", "?")


def attr(tag: str, name: str) -> str:
    value = rf"""(?i)^{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)$"""
    found = f"list_filter({every(f'substr({tag}, 2)', re2(tags.UNIT))}, lambda u: {has('u', value)})[1]"
    bare = sub(ext(found, value, 1), "^[\"']|[\"']$", "")
    return f"coalesce({bare}, '')"


def has_attr(tag: str, name: str) -> str:
    bare = sub(tag, r""""[^"]*"|'[^']*'""", '""')
    return has(bare, rf"""(?i)[\s"'/]{name}(?:[\s=/]|>)""")


def netloc(u: str) -> str:
    return ext(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(u: str) -> str:
    return ext(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(u: str) -> str:
    return ext(u, r"^[^?#]*\?([^#]*)", 1)


def param(u: str, name: str) -> str:
    return f"url_decode(replace(nullif({ext(query_of(u), f'(?:^|&){name}=([^&]+)', 1)}, ''), '+', ' '))"


IP_HOST = f"^{net.IPV4}$"
PRIVATE = "^(?:" + "|".join(p.replace(".", r"\.") for p in L.PRIVATE_PREFIXES_INDICATOR) + ")"
PRIVATE_REP = "^(?:" + "|".join(p.replace(".", r"\.") for p in L.PRIVATE_PREFIXES_REPUTATION) + ")"


def domains_of(src: str, key: str, host_expr: str) -> str:
    """Rows of ``src`` (distinct ``key``) with host, suffix, label, domain and subdomain."""
    return f"""
    SELECT *, CASE WHEN suffix <> '' AND label <> '' THEN label || '.' || suffix ELSE '' END AS domain,
      CASE WHEN label = '' OR rest = label OR is_ip THEN '' ELSE left(rest, (length(rest) - length(label) - 1)::INT) END AS subdomain
    FROM (SELECT *, CASE WHEN is_ip THEN host ELSE split_part(rest, '.', -1) END AS label
      FROM (SELECT *, CASE WHEN suffix = '' THEN host WHEN host = suffix THEN '' ELSE left(host, (length(host) - length(suffix) - 1)::INT) END AS rest
        FROM (SELECT {key}, any_value(netloc) AS netloc, any_value(host) AS host, {has("any_value(host)", IP_HOST)} AS is_ip,
                CASE WHEN {has("any_value(host)", IP_HOST)} THEN '' ELSE coalesce(arg_max(sfx, length(sfx)), '') END AS suffix
              FROM (SELECT *, lower({sub(sub("netloc", "^.*@", ""), ":[0-9]*$", "")}) AS host FROM (SELECT {key}, {host_expr} AS netloc FROM {src}) a) b
              LEFT JOIN (SELECT unnest([{values(L.SUFFIXES)}]) AS sfx) s ON host = sfx OR ends_with(host, '.' || sfx)
              GROUP BY {key}) c) d) e"""


def _host(u: str) -> str:
    return netloc(u)


def duck(sql: str, **names: str) -> str:
    """A fixture text with its table names filled in."""
    return sql.format(**{**{t: t for t in fixtures.TABLES}, **names})


# --- CTEs ---------------------------------------------------------------------------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (deps, sql)


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return (("WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n") if order else "") + body


cte("corpus", duck(fixtures.CORPUS))
cte("labelled", f"""
  SELECT mail_id, CASE WHEN k IN ({values(k for k, v in L.LABELS_STRICT.items() if v == 0)}) THEN 0
                       WHEN k IN ({values(k for k, v in L.LABELS_STRICT.items() if v == 1)}) THEN 1 END AS label, raw_email, source
  FROM (SELECT *, lower({strip("label")}) AS k FROM corpus)""", "corpus")
cte("curated", f"SELECT * FROM labelled WHERE label IS NOT NULL AND {strip('raw_email')} <> ''", "labelled")
cte("ranked", f"""
  SELECT *, row_number() OVER (PARTITION BY lower({strip("raw_email")}) ORDER BY
    CASE source WHEN 'chat' THEN 1 WHEN 'bench' THEN 2 WHEN 'src3' THEN 3 ELSE 6 END, mail_id) AS rn FROM curated""", "curated")
cte("deduped", "SELECT mail_id, label, raw_email, source FROM ranked WHERE rn = 1", "ranked")
cte("ranked200", CTES["ranked"][1].replace(f"lower({strip('raw_email')})", f"lower(substr({strip('raw_email')}, 1, 200))"), "curated")

cte("mail_raw", duck(fixtures.MAIL_RAW, b64="to_base64(encode(", b64_end="))"))
cte("mail_head", f"""
  SELECT mail_id, label, source, raw_email, {sub("substr(raw_email, 1, instr(raw_email, chr(10) || chr(10)) - 1)", r"\n[ \t]+", " ")} AS head,
    substr(raw_email, instr(raw_email, chr(10) || chr(10)) + 2) AS body FROM mail_raw""", "mail_raw")
cte("mail_field", "SELECT mail_id, label, source, raw_email, head, body AS coded, " + ", ".join(f"{field('head', h)} AS {c}" for c, h in FIELDS.items())
    + rf", {has('head', r'(?i)(?:^|\n)dkim-signature:')}::INT AS dkim_signed FROM mail_head", "mail_head")
cte("mail_cut", "SELECT *, CASE WHEN starts_with(lower(content_type), 'multipart/') THEN string_split(chr(10) || coded, chr(10) || '--' || "
    + ext("content_type", 'boundary="([^"]*)"', 1) + ") END AS cut FROM mail_field", "mail_field")
_content = lambda c: f"substr({c}, instr({c}, chr(10) || chr(10)) + 2)"
cte("mail", "SELECT *, CASE WHEN contains(lower(content_type), 'html') THEN '' ELSE body END AS body_text, CASE WHEN contains(lower(content_type), 'html') THEN body ELSE '' END AS body_html "
    f"FROM (SELECT * EXCLUDE (coded, cut), CASE WHEN cut IS NOT NULL THEN {_content('cut[2]')} || chr(10) WHEN lower(content_transfer_encoding) = 'base64' THEN decode(from_base64(trim(coded, chr(10)))) "
    "ELSE coded END AS body FROM mail_cut)", "mail_cut")
cte("attached", f"SELECT mail_id, {ext('cut[3]', 'filename="([^"]*)"', 1)} AS filename, sha256(from_base64({_content('cut[3]')})) AS sha256 FROM mail_cut WHERE cut IS NOT NULL", "mail_cut")
cte("relay", f"""
  SELECT mail_id, unnest(r) AS received, generate_subscripts(r, 1) - 1 AS pos
  FROM (SELECT mail_id, {every("head", r"(?i)(?:^|\n)received:[ \t]*([^\n]*)", 1)} AS r FROM mail_head)""", "mail_head")
cte("raw_link", f"""
  SELECT mail_id, 1 AS grp, unnest(u) AS url, generate_subscripts(u, 1) AS i FROM (SELECT mail_id, {every("body_text", net.URL_IN_TEXT)} AS u FROM mail)
  UNION ALL SELECT mail_id, 2, unnest(u), generate_subscripts(u, 1) FROM (SELECT mail_id, {every("body_html", net.URL_IN_TEXT)} AS u FROM mail)
  UNION ALL SELECT mail_id, 3, {strip(attr("t", "href"))}, i FROM (SELECT mail_id, unnest(u) AS t, generate_subscripts(u, 1) AS i FROM (
      SELECT mail_id, {every("body_html", re2(tags.ANCHOR))} AS u FROM mail)) WHERE {has(strip(attr("t", "href")), "^(?i)https?://")}
  UNION ALL SELECT mail_id, 4, {strip(attr("t", "src"))}, i FROM (SELECT mail_id, unnest(u) AS t, generate_subscripts(u, 1) AS i FROM (
      SELECT mail_id, {every("body_html", re2(tags.SOURCE))} AS u FROM mail)) WHERE {has(strip(attr("t", "src")), "^(?i)https?://")}""", "mail")
cte("mail_url", f"""
  SELECT mail_id, url, row_number() OVER (PARTITION BY mail_id ORDER BY first) - 1 AS pos FROM (
    SELECT mail_id, {sub("url", r'''[.,;)'"]+$''', "")} AS url, min(grp * 1000000 + i) AS first FROM raw_link GROUP BY 1, 2) WHERE url <> ''""", "raw_link")
cte("du", "SELECT DISTINCT url FROM mail_url", "mail_url")
cte("url_dom", domains_of("du", "url", _host("url")), "du")
cte("url_ent", """
  SELECT url, -sum(p * log2(p)) AS entropy FROM (
    SELECT url, c, count(*)::DOUBLE / any_value(length(url)) AS p FROM (SELECT url, unnest(string_split(url, '')) AS c FROM du) GROUP BY url, c) GROUP BY url""", "du")
_brand_sub = "(" + " OR ".join(f"(contains(subdomain, {lit(b)}) AND NOT contains(domain, {lit(b)}))" for b in dict.fromkeys(L.BRANDS)) + ")"
cte("url_lex", f"""
  SELECT url, length(domain) AS domain_length, CASE WHEN subdomain = '' THEN 0 ELSE length(subdomain) - length(replace(subdomain, '.', '')) + 1 END AS subdomain_depth,
    {n_match("domain", "-")} AS hyphen_count, CASE WHEN netloc = '' THEN 0.0 ELSE {n_match("netloc", "[0-9]")}::DOUBLE / length(netloc) END AS digit_ratio,
    entropy AS url_entropy, (subdomain <> '' AND {_brand_sub})::INT AS brand_in_subdomain,
    CASE WHEN suffix IN ({values(L.RISK_TLDS)}) THEN 1.0 WHEN suffix IN ({values(L.SAFE_TLDS)}) THEN 0.0 ELSE 0.5 END::DOUBLE AS tld_risk_score,
    {has("url", f"^https?://{net.IPV4}")}::INT AS is_ip_address,
    (contains(lower(url), 'xn--') OR {has("netloc", "[\\x{370}-\\x{3FF}\\x{400}-\\x{52F}]")})::INT AS punycode_detected,
    {any_in("lower(netloc)", L.SHORTENERS)}::INT AS url_shortener, {n_match(path("url"), "[^/]+")} AS path_depth,
    {count_in("lower(url)", L.URL_KEYWORDS)} + CASE WHEN contains(netloc, '@') THEN 3 ELSE 0 END AS suspicious_keywords_in_url
  FROM url_dom JOIN url_ent USING (url)""", "url_dom", "url_ent")
cte("url_feat", "SELECT m.mail_id, coalesce(any_value(n.n), 0)::BIGINT AS url_url_count, " + ", ".join(
    f"coalesce(max({f}), 0)::DOUBLE AS url_{f}_max, coalesce(avg({f}), 0)::DOUBLE AS url_{f}_mean" for f in L.URL_FEATURES)
    + """ FROM mail m LEFT JOIN (SELECT mail_id, count(*) AS n FROM mail_url GROUP BY 1) n USING (mail_id)
    LEFT JOIN (SELECT mail_id, url FROM mail_url) u USING (mail_id) LEFT JOIN url_lex USING (url) GROUP BY m.mail_id""", "mail", "url_lex")

_addr = lambda c: (f"CASE WHEN {ext(c, '[a-zA-Z0-9_.+-]+@([a-zA-Z0-9_.-]+[.][a-zA-Z]{2,})', 1)} <> '' THEN {ext(c, '[a-zA-Z0-9_.+-]+@([a-zA-Z0-9_.-]+[.][a-zA-Z]{2,})', 1)} "
                   f"ELSE {ext(strip(c), '^([a-zA-Z0-9_.-]+[.][a-zA-Z]{2,})$', 1)} END")
cte("addr", "SELECT mail_id, kind, address, lower(domain) AS host FROM (" + " UNION ALL ".join(
    f"SELECT mail_id, '{c}' AS kind, {c} AS address, {_addr(c)} AS domain FROM mail" for c in ("from_address", "reply_to", "return_path")) + ")", "mail")
cte("addr_dom", domains_of("(SELECT DISTINCT host AS h FROM addr WHERE host <> '')", "h", "h"), "addr")
cte("addr_reg", "SELECT mail_id, kind, CASE WHEN coalesce(domain, '') <> '' THEN domain ELSE addr.host END AS reg FROM addr LEFT JOIN addr_dom ON addr.host = addr_dom.h",
    "addr", "addr_dom")
cte("addr_wide", "SELECT mail_id, " + ", ".join(f"max(CASE WHEN kind = '{k}' THEN reg END) AS {k}_reg" for k in ("from_address", "reply_to", "return_path"))
    + " FROM addr_reg GROUP BY mail_id", "addr_reg")
cte("relay_ip", f"""
  SELECT mail_id, pos, unnest(ips) AS ip, generate_subscripts(ips, 1) AS i FROM (SELECT mail_id, pos, {every("received", net.IPV4_WORD)} AS ips FROM relay)""", "relay")
cte("geo", r"""
  SELECT m.mail_id, (coalesce(hops, 0) >= 2 AND coalesce(n, 0) >= 2 AND coalesce(nets, 0) > 2)::INT AS received_geo_anomaly, coalesce(hops, 0)::BIGINT AS received_hop_count
  FROM mail m LEFT JOIN (SELECT mail_id, count(*) AS hops FROM relay GROUP BY 1) a USING (mail_id)
  LEFT JOIN (SELECT mail_id, count(*) AS n, count(DISTINCT CASE WHEN NOT regexp_matches(ip, '^(?:10\.|192\.168\.|127\.)') THEN split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) END) AS nets
             FROM relay_ip GROUP BY 1) b USING (mail_id)""", "mail", "relay", "relay_ip")


def auth_score(check: str) -> str:
    word = ext("auth", rf"\b{check}\s*=\s*(\w+)", 1)
    return "CASE " + word + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.AUTH_SCORES.items()) + " END"


cte("auth", f"""
  SELECT mail_id, coalesce({auth_score("spf")}, 0) AS spf_result,
    CASE WHEN stated AND dkim_signed = 1 THEN greatest(coalesce({auth_score("dkim")}, 0), 0) ELSE coalesce({auth_score("dkim")}, 0) END AS dkim_result,
    coalesce({auth_score("dmarc")}, 0) AS dmarc_result
  FROM (SELECT mail_id, dkim_signed, lower(auth_results || ' ' || received_spf_header) AS auth, (auth_results <> '' OR received_spf_header <> '') AS stated FROM mail)""", "mail")
_fm = "|".join(d.replace(".", r"\.") for d in L.FREEMAIL)
_mid_host = f"lower({sub('split_part(message_id, chr(64), -1)', '>+$', '')})"
cte("hdr", f"""
  SELECT m.mail_id, (from_address_reg <> '' AND reply_to_reg <> '' AND from_address_reg <> reply_to_reg)::INT AS hdr_from_reply_to_mismatch,
    (from_address_reg <> '' AND return_path_reg <> '' AND from_address_reg <> return_path_reg)::INT AS hdr_from_return_path_mismatch,
    {has("reply_to", f"(?i)@({_fm})")}::INT AS hdr_reply_to_freemail, received_hop_count AS hdr_received_hop_count, received_geo_anomaly AS hdr_received_geo_anomaly,
    spf_result AS hdr_spf_result, dkim_result AS hdr_dkim_result, dmarc_result AS hdr_dmarc_result,
    (message_id = '' OR NOT {has(strip("message_id"), "^<[^@]+@[^>]+>")} OR {"(" + " OR ".join(f"starts_with({_mid_host}, {lit(d)})" for d in L.FREEMAIL) + ")"})::INT AS hdr_message_id_suspicious,
    ({ext("date", "([+-][0-9]{4})", 1)} <> '' AND coalesce({ext("origin", "([+-][0-9]{4})", 1)}, '') <> '' AND {ext("date", "([+-][0-9]{4})", 1)} <> {ext("origin", "([+-][0-9]{4})", 1)})::INT AS hdr_timezone_mismatch,
    {has("x_mailer", "(?i)" + "|".join(L.BULK_MAILERS))}::INT AS hdr_x_mailer_suspicious, {has("head", "[\\r\\n\\x00]")}::INT AS hdr_header_injection_attempt
  FROM mail m JOIN addr_wide USING (mail_id) JOIN geo USING (mail_id) JOIN auth USING (mail_id)
  LEFT JOIN (SELECT mail_id, arg_max(received, pos) AS origin FROM relay GROUP BY 1) o USING (mail_id)""", "mail", "addr_wide", "geo", "auth", "relay")

# HTML: one row per tag
HIDDEN_RE2 = "(?i)" + "|".join(f"(?:{p})" for p in L.HIDDEN_STYLES).replace(r"0(?!\.\d)", r"0(?:$|[^.]|\.(?:$|[^0-9]))")


def html_ctes(prefix: str, src: str, key: str, column: str, *deps: str) -> None:
    p = prefix
    cte(f"{p}_clean", f"SELECT {key}, {sub(column, re2(tags.HIDDEN), chr(92) + '1' + chr(92) + '2' + chr(92) + '3')} AS clean FROM {src}", *deps)
    cte(f"{p}_tag", f"SELECT {key}, unnest(t) AS tag FROM (SELECT {key}, {every('clean', re2(tags.OPEN))} AS t FROM {p}_clean)", f"{p}_clean")
    cte(f"{p}_href", f"SELECT {key}, {attr('tag', 'href')} AS href FROM {p}_tag WHERE {has('tag', r'(?i)^<a' + chr(92) + 'b')} AND {has_attr('tag', 'href')}", f"{p}_tag")
    cte(f"{p}_hdom", domains_of(f"(SELECT DISTINCT href FROM {p}_href WHERE starts_with(href, 'http'))", "href", _host("href")), f"{p}_href")
    cte(f"{p}_links", f"SELECT {key}, count(*) AS links, count(DISTINCT CASE WHEN domain <> '' THEN domain END) AS domains FROM {p}_href LEFT JOIN {p}_hdom USING (href) GROUP BY {key}",
        f"{p}_href", f"{p}_hdom")
    href = strip(attr(ext("a", re2(tags.ANCHOR)), "href"))
    cte(f"{p}_anchor", f"SELECT {key}, {href} AS href, {strip(sub('a', re2(tags.ANY), ''))} AS shown FROM (SELECT {key}, unnest(x) AS a FROM (SELECT {key}, {every('clean', re2(tags.LINKED))} AS x FROM {p}_clean))", f"{p}_clean")
    to = sub(f"lower({netloc('href')})", r"^www\.", "")
    says = sub(f"lower({ext('shown', r'[a-zA-Z0-9_' + chr(92) + r'-]+' + chr(92) + '.[a-zA-Z]{2,}')})", r"^www\.", "")
    cte(f"{p}_mis", f"""SELECT {key}, count(*) AS mismatches FROM {p}_anchor WHERE {has('href', '^https?://')} AND shown <> '' AND (
        ({has('href', '^https?://' + net.IPV4)} AND {has('shown', '[a-zA-Z]{3,}[.][a-zA-Z]{2,}')})
        OR ({has('shown', '[a-zA-Z0-9][.-][a-zA-Z]{2,}')} AND {to} <> '' AND {says} <> '' AND {to} <> {says})) GROUP BY {key}""", f"{p}_anchor")
    is_ = lambda n: has("tag", rf"(?i)^<(?:{n})\b")
    words = n_words(sub(sub("clean", re2(tags.ANY), ""), "&nbsp;|&#160;", " "))
    cte(f"{p}_agg", f"""SELECT {key}, coalesce(max(({is_('form')} AND {has(attr('tag', 'action'), '^https?://')})::INT), 0) AS form,
        (count_if({has(attr('tag', 'style'), HIDDEN_RE2)}) + count_if({has_attr('tag', 'hidden')}))::BIGINT AS hidden, count_if({is_('img')})::BIGINT AS images,
        count_if({is_('img')} AND (({attr('tag', 'width')} = '1' AND {attr('tag', 'height')} = '1') OR contains(lower({attr('tag', 'src')}), 'tracking')))::BIGINT AS pixels,
        count_if({is_('script')})::BIGINT AS scripts, count_if({is_('link')} AND contains(lower({attr('tag', 'rel')}), 'stylesheet') AND starts_with({attr('tag', 'href')}, 'http'))::BIGINT AS sheets,
        coalesce(max(({is_('meta')} AND lower({attr('tag', 'http-equiv')}) = 'refresh' AND contains(lower({attr('tag', 'content')}), 'url='))::INT), 0) AS refresh
        FROM {p}_tag GROUP BY {key}""", f"{p}_tag")
    cte(f"{p}_feat", f"""SELECT c.{key}, coalesce(mismatches, 0)::BIGINT AS html_href_text_mismatch_count, coalesce(form, 0) AS html_external_form_action, coalesce(hidden, 0) AS html_hidden_text_count,
        CASE WHEN {words} = 0 THEN coalesce(images, 0)::DOUBLE ELSE coalesce(images, 0)::DOUBLE / {words} END AS html_image_to_text_ratio,
        coalesce(pixels, 0) AS html_tracking_pixel_count, {n_match('clean', '(?i)data:[^;]+;base64,')} AS html_base64_content_count, coalesce(scripts, 0) AS html_javascript_count,
        coalesce(sheets, 0) AS html_external_css_count, coalesce(links, 0)::BIGINT AS html_total_links, coalesce(domains, 0)::BIGINT AS html_unique_domains_in_links,
        CASE WHEN coalesce(links, 0) = 0 THEN 0.0 ELSE domains::DOUBLE / links END AS html_link_domain_diversity
        FROM {p}_clean c LEFT JOIN {p}_agg USING ({key}) LEFT JOIN {p}_mis USING ({key}) LEFT JOIN {p}_links USING ({key})""",
        f"{p}_clean", f"{p}_agg", f"{p}_mis", f"{p}_links")


html_ctes("mh", "mail", "mail_id", "body_html", "mail")
html_ctes("ph", "pages", "page_id", "html")

_subject_words = f"list_filter({every('subject', f'[^{X.SPACE}]+')}, lambda w: length(w) > 1 AND upper(w) = w AND lower(w) <> w)"


def urgency(c: str) -> tuple[str, str]:
    n = count_in(f"lower({c})", L.URGENCY_PHRASES)
    return f"least({n} / (greatest({n_words(c)}, 1) / 100.0::DOUBLE), 1.0)::DOUBLE", n


cte("txt", f"""
  SELECT mail_id, {urgency("body_text")[0]} AS txt_urgency_score_normalised, {urgency("body_text")[1]} AS txt_urgency_phrase_count, length(subject) AS txt_subject_length,
    {n_match("subject", "!")} AS txt_subject_exclamation_count, {n_match("subject", "[?]")} AS txt_subject_question_count,
    len({_subject_words})::DOUBLE / greatest({n_words("subject")}, 1) AS txt_subject_caps_ratio, {has("subject", "(?i)^(?:re:|fw:|fwd:)")}::INT AS txt_subject_spoofed_re_fw,
    {any_in("lower(subject)", dict.fromkeys(L.BRANDS))}::INT AS txt_subject_brand_keyword, {any_in("lower(subject)", L.SUBJECT_URGENCY)}::INT AS txt_subject_urgency_keyword,
    {n_match("subject", "[$]")} AS txt_subject_dollar_count FROM mail""", "mail")

# look-ups
cte("sender", f"""SELECT mail_id, arg_max(ip, pos * 1000 - i) AS ip FROM relay_ip WHERE NOT {has("ip", "^(?:10[.]|192[.]168[.]|127[.]|0[.]0[.]0[.]0)")} GROUP BY mail_id""", "relay_ip")
cte("url_rep", lookups.URL_REP.format(src="du"), "du")
cte("dd", "SELECT DISTINCT domain FROM url_dom WHERE domain <> ''", "url_dom")
cte("domain_rep", lookups.DOMAIN_REP.format(src="dd"), "dd")
cte("blocklist", lookups.BLOCKLIST.format(src="du"), "du")
cte("malware_urls", lookups.MALWARE_URLS.format(src="du"), "du")
cte("url_scan", lookups.URL_SCAN.format(src="du"), "du")
cte("ip_rep", lookups.IP_REP.format(src="(SELECT DISTINCT ip FROM sender)"), "sender")
cte("from_addr", f"SELECT mail_id, {ext('from_address', net.ADDRESS)} AS address FROM mail", "mail")
cte("fraud_key", """SELECT mail_id, 'url' AS kind, url AS key FROM mail_url WHERE pos = 0 UNION ALL SELECT mail_id, 'email', address FROM from_addr
  UNION ALL SELECT mail_id, 'ip', ip FROM sender""", "mail_url", "from_addr", "sender")
cte("fraud_rep", lookups.FRAUD_REP.format(src="(SELECT DISTINCT kind, key AS item FROM fraud_key)"), "fraud_key")
cte("mail_dom", """SELECT mail_id, domain FROM (SELECT mail_id, domain, row_number() OVER (PARTITION BY mail_id ORDER BY first) AS rn FROM (
    SELECT mail_id, domain, min(pos) AS first FROM mail_url JOIN url_dom USING (url) WHERE domain <> '' GROUP BY 1, 2))""", "mail_url", "url_dom")
cte("whois", lookups.WHOIS.format(src="dd"), "dd")
cte("cert_log", lookups.CERT_LOG.format(src="dd"), "dd")
cte("redirect_map", lookups.REDIRECT_MAP.format(src="du"), "du")
cte("ai_answer", lookups.AI_ANSWER.format(src="mail"), "mail")
cte("whois_one", f"""SELECT mail_id, domain, coalesce(age, -1) AS domain_age_days, CASE WHEN age IS NULL THEN 0.5 WHEN age < 30 THEN 1.0 WHEN age < 90 THEN 0.5 ELSE 0.0 END::DOUBLE AS domain_age_risk,
    {any_in("lower(coalesce(registrar, ''))", L.ABUSE_REGISTRARS)}::INT::DOUBLE AS registrar_risk
  FROM (SELECT mail_id, domain, registrar, date_diff('day', created, DATE '{lookups.AS_OF}') AS age FROM mail_dom LEFT JOIN whois USING (domain))""", "mail_dom", "whois")
_brand_san = "(" + " OR ".join(f"(contains(lower(san), {lit(b)}) AND NOT contains(domain, {lit(b)}))" for b in dict.fromkeys(L.BRANDS)) + ")"
cte("cert_one", f"""SELECT mail_id, domain, coalesce(age, -1) AS cert_age_days, coalesce(le, 0) AS cert_lets_encrypt, coalesce(bm, 0) AS cert_brand_mismatch FROM mail_dom LEFT JOIN (
    SELECT domain, min(date_diff('day', CAST(not_before AS DATE), DATE '{lookups.AS_OF}')) AS age, max(contains(lower(issuer), 'lets encrypt')::INT) AS le, max({_brand_san}::INT) AS bm FROM cert_log GROUP BY domain) c USING (domain)""",
    "mail_dom", "cert_log")
cte("whois_mail", """SELECT mail_id, coalesce(min(CASE WHEN domain_age_days >= 0 THEN domain_age_days END), -1) AS url_domain_age_days, max(domain_age_risk) AS url_domain_age_risk,
    max(registrar_risk) AS url_registrar_risk FROM whois_one GROUP BY mail_id""", "whois_one")
cte("cert_mail", """SELECT mail_id, coalesce(min(CASE WHEN cert_age_days >= 0 THEN cert_age_days END), -1) AS url_cert_age_days, max(cert_lets_encrypt) AS url_cert_lets_encrypt,
    max(cert_brand_mismatch) AS url_cert_brand_mismatch FROM cert_one GROUP BY mail_id""", "cert_one")
cte("block_mail", """SELECT mail_id, max((n IS NOT NULL)::INT) AS gsb_is_flagged, coalesce(sum(n), 0)::INT AS gsb_threat_count
  FROM mail_url LEFT JOIN (SELECT url, count(*) AS n FROM blocklist GROUP BY url) b USING (url) GROUP BY mail_id""", "mail_url", "blocklist")
cte("intel", f"""
  SELECT m.mail_id, coalesce(r.malicious, -1) AS intel_vt_malicious, coalesce(r.suspicious, -1) AS intel_vt_suspicious, coalesce(r.clean, -1) AS intel_vt_clean,
    coalesce(r.reputation, 0) AS intel_vt_reputation, coalesce(b.gsb_is_flagged, -1) AS intel_gsb_is_flagged, coalesce(b.gsb_threat_count, -1) AS intel_gsb_threat_count,
    coalesce(s.malicious, -1) AS intel_urlscan_malicious, coalesce(s.brand, -1) AS intel_urlscan_brand_impersonated, coalesce(s.redirects, -1) AS intel_urlscan_redirect_count,
    coalesce(w.listed, -1) AS intel_urlhaus_threat, coalesce(i.score, -1) AS intel_abuse_confidence_score, coalesce(i.reports, -1) AS intel_abuse_total_reports, coalesce(i.is_tor, -1) AS intel_abuse_is_tor
  FROM mail m LEFT JOIN (SELECT mail_id, url FROM mail_url WHERE pos = 0) p USING (mail_id) LEFT JOIN url_rep r ON p.url = r.url LEFT JOIN block_mail b ON m.mail_id = b.mail_id
  LEFT JOIN url_scan s ON p.url = s.url LEFT JOIN malware_urls w ON p.url = w.url LEFT JOIN sender x ON m.mail_id = x.mail_id
  LEFT JOIN ip_rep i ON x.ip = i.ip AND NOT {has("x.ip", PRIVATE_REP)}""", "mail", "mail_url", "url_rep", "block_mail", "url_scan", "malware_urls", "sender", "ip_rep")
cte("fraud_one", """SELECT k.mail_id, k.kind, k.key, coalesce(score, -1) AS fraud_score, coalesce(flagged, -1) AS fraud_flag
  FROM fraud_key k LEFT JOIN fraud_rep r ON k.kind = r.kind AND k.key = r.key""", "fraud_key", "fraud_rep")
cte("fraud_mail", """SELECT m.mail_id, coalesce(max(CASE WHEN kind = 'url' THEN fraud_score END), -1) AS fu, coalesce(max(CASE WHEN kind = 'url' THEN fraud_flag END), -1) AS ff,
    coalesce(max(CASE WHEN kind = 'email' THEN fraud_score END), -1) AS fe, coalesce(max(CASE WHEN kind = 'ip' THEN fraud_score END), -1) AS fi
  FROM mail m LEFT JOIN fraud_one USING (mail_id) GROUP BY m.mail_id""", "mail", "fraud_one")
cte("tools", """
  SELECT mail_id, CASE WHEN intel_vt_malicious > 0 THEN 'MALICIOUS' WHEN intel_vt_suspicious > 0 THEN 'SUSPICIOUS' WHEN intel_vt_malicious = -1 THEN 'N/A' ELSE 'CLEAN' END AS vt_verdict,
    CASE intel_gsb_is_flagged WHEN 1 THEN 'MALICIOUS' WHEN 0 THEN 'CLEAN' ELSE 'N/A' END AS gsb_verdict, CASE intel_urlhaus_threat WHEN 1 THEN 'MALICIOUS' WHEN 0 THEN 'CLEAN' ELSE 'N/A' END AS urlhaus_verdict,
    CASE WHEN intel_urlscan_malicious = 1 THEN 'MALICIOUS' WHEN intel_urlscan_brand_impersonated = 1 THEN 'SUSPICIOUS' WHEN intel_urlscan_malicious = -1 THEN 'N/A' ELSE 'CLEAN' END AS urlscan_verdict,
    CASE WHEN intel_abuse_confidence_score = -1 THEN 'N/A' WHEN intel_abuse_confidence_score >= 50 THEN 'MALICIOUS' WHEN intel_abuse_confidence_score >= 20 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS abuseipdb_verdict,
    CASE WHEN ff = 1 OR fu >= 75 THEN 'MALICIOUS' WHEN fu >= 50 OR fe >= 75 OR fi >= 75 THEN 'SUSPICIOUS' WHEN fu = -1 AND fe = -1 THEN 'N/A' ELSE 'CLEAN' END AS ipqs_verdict
  FROM intel JOIN fraud_mail USING (mail_id)""", "intel", "fraud_mail")
cte("feat", """SELECT hdr.*, url_feat.* EXCLUDE (mail_id), coalesce(url_domain_age_days, -1) AS url_domain_age_days, coalesce(url_domain_age_risk, 0.0) AS url_domain_age_risk,
    coalesce(url_registrar_risk, 0.0) AS url_registrar_risk, coalesce(url_cert_age_days, -1) AS url_cert_age_days, coalesce(url_cert_lets_encrypt, 0) AS url_cert_lets_encrypt,
    coalesce(url_cert_brand_mismatch, 0) AS url_cert_brand_mismatch, mh_feat.* EXCLUDE (mail_id), txt.* EXCLUDE (mail_id), intel.* EXCLUDE (mail_id)
  FROM hdr JOIN url_feat USING (mail_id) JOIN mh_feat USING (mail_id) JOIN txt USING (mail_id) JOIN intel USING (mail_id) LEFT JOIN whois_mail USING (mail_id) LEFT JOIN cert_mail USING (mail_id)""",
    "hdr", "url_feat", "mh_feat", "txt", "intel", "whois_mail", "cert_mail")
cte("scored", lookups.SCORED.format(src="documents"))
# a fixed logistic score stands in for a trained model wherever a probability is needed
PROB = "round(1 / (1 + exp(-(-1.2 + 1.1 * url_tld_risk_score_max + 0.8 * hdr_from_reply_to_mismatch - 0.6 * hdr_spf_result + 0.3 * txt_urgency_phrase_count))), 4)"
cte("pscore", f"SELECT mail_id, {PROB} AS prob FROM feat", "feat")

def mix(*parts: str) -> str:
    """The same pseudo-random number as ``functions.mix``, spelled out."""
    h = "7::BIGINT"
    for p in parts:
        h = f"(({h}) * 48271 + ({p})::BIGINT % 2147483647) % 2147483647"
        h = f"(list_transform([{h}], lambda q: (q * q + 1013904223) % 2147483647)[1])"
    return h


def pick(n: int, *parts: str, seed: int = 42) -> str:
    return f"(({mix(str(seed), *parts)}) >> 7) % {n}"


def noise(c: str, sigma: str) -> str:
    """A feature with Gaussian noise."""
    digest = lambda tag: f"md5('42|{tag}|{c}|' || mail_id || '|' || round({sigma} * 1e6)::BIGINT)"
    u = lambda tag: f"(('0x' || substr({digest(tag)}, 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE"
    return f"({c}::DOUBLE + {sigma} * sqrt(-2.0::DOUBLE * ln({u(1)})) * cos(2.0::DOUBLE * pi() * {u(2)}))"


# indicators
cte("ioc_addr", "SELECT DISTINCT mail_id, unnest(regexp_extract_all(v, " + lit(net.ADDRESS) + ")) AS value FROM (SELECT mail_id, unnest([from_address, reply_to, return_path]) AS v FROM mail)", "mail")
cte("ioc_ip", f"""SELECT DISTINCT mail_id, ip AS value FROM (SELECT mail_id, ip FROM relay_ip UNION ALL SELECT mail_id, unnest({every("x_originating_ip", net.IPV4_WORD)}) FROM mail)
  WHERE NOT {has("ip", PRIVATE)}""", "relay_ip", "mail")


def refang(c: str) -> str:
    return sub(sub(f"replace({c}, '[://]', '://')", "(?i)hxxp(s?)://", "http\\1://"), r"\[\.?\]|\(\.\)", ".")


cte("ioc_url", f"""SELECT DISTINCT mail_id, {sub("u", r'''[.,;)'"]+$''', "")} AS url FROM (
    SELECT mail_id, url AS u FROM mail_url UNION ALL SELECT mail_id, unnest({every(refang("body"), net.URL_IN_BODY)}) FROM mail)""", "mail_url", "mail")


def _target(t: str) -> str:
    return f"(starts_with({t}, 'http://') OR starts_with({t}, 'https://'))"


def unwrap_pass(src: str) -> str:
    """One pass over ``src(url, cur, method, wrapped)``: the first rule with a target wins."""
    http = lambda e: f"nullif({ext(e, '(?s)^(https?://.*)$', 1)}, '')"
    host, p = f"lower({netloc('cur')})", path("cur")
    defense = f"(contains({host}, 'urldefense.com') OR contains({host}, 'urldefense.proofpoint.com'))"
    v2 = "url_decode(regexp_replace(url_decode(" + sub(param("cur", "u"), "-([0-9A-Fa-f]{2})", "%\\1") + "), " + lit("^(.*?)__") + ", " + lit("\\1//") + "))"
    safelinks = "url_decode(url_decode(url_decode(" + param("cur", "url") + ")))"
    rules = [
        (f"CASE WHEN {has('cur', '(?i)^https?://[a-z0-9-]+[.]safelinks[.]protection[.]outlook[.]com/')} THEN {http(safelinks)} END", L.METHOD_SAFELINKS),
        (f"CASE WHEN {defense} AND contains({p}, '/v3/__') THEN {http('url_decode(' + ext('cur', '/v3/__(.+?)__(?:;|$)', 1) + ')')} END", L.METHOD_PP_V3),
        (f"CASE WHEN {defense} AND NOT contains({p}, '/v3/__') AND contains({p}, '/v2/url') THEN {http(v2)} END", L.METHOD_PP_V2),
        (f"CASE WHEN contains({host}, 'google.com') AND {p} IN ('/url', '/url/') THEN nullif(url_decode(coalesce({param('cur', 'q')}, {param('cur', 'url')})), '') END", L.METHOD_GOOGLE),
        (f"CASE WHEN {has('cur', '(?i)^https?://links[.]barracudanetworks[.]com/')} THEN coalesce({', '.join('url_decode(' + http(param('cur', q)) + ')' for q in ('url', 'u', 'dest'))}) END", L.METHOD_BARRACUDA),
        *[(f"url_decode({http(param('cur', q))})", f"Redirect param (?{q}=)") for q in L.REDIRECT_PARAMS],
        (f"CASE WHEN url_decode(cur) <> cur THEN {http('url_decode(cur)')} END", L.METHOD_PERCENT),
    ]
    last = 5 + len(L.REDIRECT_PARAMS)
    cols = ", ".join(f"{e} AS t{i}" for i, (e, _) in enumerate(rules))
    other = lambda i: f"lower({netloc(f't{i}')}) <> '' AND lower({netloc(f't{i}')}) <> {host}"
    usable = ", ".join(f"CASE WHEN {other(i)} THEN t{i} END AS t{i}" if 5 <= i < last else f"t{i}" for i in range(len(rules)))
    method = "CASE " + " ".join(f"WHEN t{i} IS NOT NULL THEN {lit(m)}" for i, (_, m) in enumerate(rules)) + " END"
    target = "coalesce(" + ", ".join(f"t{i}" for i in range(len(rules))) + ")"
    return (f"SELECT url, CASE WHEN t <> cur THEN t ELSE cur END AS cur, CASE WHEN t <> cur THEN m ELSE method END AS method, wrapped OR coalesce(t <> cur, false) AS wrapped "
            f"FROM (SELECT url, cur, method, wrapped, {target} AS t, {method} AS m FROM (SELECT url, cur, method, wrapped, {usable} FROM (SELECT *, {cols} FROM {src})))")


def unwrap_ctes(prefix: str, start: str, *deps: str) -> None:
    cte(f"{prefix}0", f"SELECT url, {strip('url')} AS cur, 'none' AS method, false AS wrapped FROM {start}", *deps)
    for i in range(1, 7):
        cte(f"{prefix}{i}", unwrap_pass(f"{prefix}{i - 1}"), f"{prefix}{i - 1}")


unwrap_ctes("uw", "du", "du")
cte("ioc_du", "SELECT DISTINCT url FROM ioc_url", "ioc_url")
unwrap_ctes("iw", "ioc_du", "ioc_du")
cte("ioc_dom", f"""SELECT DISTINCT mail_id, d AS value FROM (SELECT mail_id, {sub(f"lower({netloc('cur')})", "^www[.]", "")} AS d FROM ioc_url JOIN iw6 USING (url)) WHERE d <> ''""", "ioc_url", "iw6")
cte("ioc_all", """SELECT mail_id, 'email' AS ioc_type, value, value AS cleaned, 'none' AS method, false AS was_wrapped FROM ioc_addr
  UNION ALL SELECT mail_id, 'ip', value, value, 'none', false FROM ioc_ip UNION ALL SELECT mail_id, 'url', url, cur, method, wrapped FROM ioc_url JOIN iw6 USING (url)
  UNION ALL SELECT mail_id, 'domain', value, value, 'none', false FROM ioc_dom UNION ALL SELECT mail_id, 'hash', sha256, sha256, 'none', false FROM attached""",
    "ioc_addr", "ioc_ip", "ioc_url", "iw6", "ioc_dom", "attached")

# technique rules as a long table
_PCT1 = "printf('%.1f', round_even(prob * 100, 1)) || '%'"
cte("rule_in", f"""SELECT feat.*, prob, CASE WHEN prob >= 0.65 THEN 'PHISHING' WHEN prob >= 0.40 THEN 'UNCERTAIN' ELSE 'LEGITIMATE' END AS verdict, coalesce(n_urls, 0) AS n_urls, coalesce(n_attachments, 0) AS n_attachments
  FROM feat JOIN pscore USING (mail_id) LEFT JOIN (SELECT mail_id, count(*) AS n_urls FROM ioc_url GROUP BY 1) n USING (mail_id)
  LEFT JOIN (SELECT mail_id, count(*) AS n_attachments FROM attached GROUP BY 1) a USING (mail_id)""", "feat", "pscore", "ioc_url", "attached")
cte("rule_row", """
  SELECT mail_id, 'T1566' AS technique_id, round_even(least(prob, 1.0), 2) AS confidence FROM rule_in WHERE verdict IN ('PHISHING', 'UNCERTAIN')
  UNION ALL SELECT mail_id, 'T1566.001', 0.85 FROM rule_in WHERE n_attachments > 0
  UNION ALL SELECT mail_id, 'T1566.002', least(0.5 + 0.1 * n_urls, 0.95) FROM rule_in WHERE n_urls > 0
  UNION ALL SELECT mail_id, 'T1036', 0.8 FROM rule_in WHERE url_brand_in_subdomain_max > 0 OR url_cert_brand_mismatch > 0 OR url_punycode_detected_max > 0
  UNION ALL SELECT mail_id, 'T1204', least(txt_urgency_score_normalised, 0.9) FROM rule_in WHERE txt_urgency_score_normalised > 0.3
  UNION ALL SELECT mail_id, 'T1056', 0.75 FROM rule_in WHERE html_external_form_action > 0
  UNION ALL SELECT mail_id, 'T1027', 0.7 FROM rule_in WHERE html_base64_content_count > 0 OR html_hidden_text_count > 0 OR html_javascript_count > 2 OR url_url_entropy_max > 4.5
  UNION ALL SELECT mail_id, 'T1078', 0.6 FROM rule_in WHERE url_suspicious_keywords_in_url_max > 0
  UNION ALL SELECT mail_id, 'T1071.003', 0.65 FROM rule_in WHERE least(hdr_spf_result, hdr_dkim_result, hdr_dmarc_result) < 0
  UNION ALL SELECT mail_id, 'T1598', 0.72 FROM rule_in WHERE html_external_form_action > 0 AND url_suspicious_keywords_in_url_max > 0
  UNION ALL SELECT mail_id, 'T1539', 0.68 FROM rule_in WHERE html_external_form_action > 0 AND txt_urgency_score_normalised > 0.5""", "rule_in")
cte("config_row", "SELECT DISTINCT mail_id, technique_id FROM (" + " UNION ALL ".join(
    f"SELECT mail_id, '{v[0]}' AS technique_id FROM rule_in WHERE {f} > 0" for f, v in L.FEATURE_TECHNIQUES.items())
    + ") c WHERE NOT EXISTS (SELECT 1 FROM rule_row r WHERE r.mail_id = c.mail_id AND r.technique_id = c.technique_id)", "rule_in", "rule_row")
cte("calibrated", """
  SELECT mail_id, technique_id, CASE verdict WHEN 'LEGITIMATE' THEN round_even(confidence * least(0.30, greatest(0.05, prob) * 3.0), 2)
      WHEN 'UNCERTAIN' THEN round_even(least(confidence * least(1.0, greatest(0.45, prob / 0.65)), 0.80), 2) ELSE confidence END AS confidence, verdict
  FROM (SELECT mail_id, technique_id, round(confidence::DOUBLE, 6) AS confidence FROM rule_row UNION ALL SELECT mail_id, technique_id, 0.65::DOUBLE FROM config_row) JOIN rule_in USING (mail_id)""",
    "rule_row", "config_row", "rule_in")
cte("technique_kept", """SELECT mail_id, technique_id, confidence FROM calibrated WHERE (verdict = 'PHISHING' OR confidence >= 0.05)
  AND NOT (verdict = 'LEGITIMATE' AND technique_id IN ('T1566', 'T1566.001', 'T1566.002', 'T1566.003'))""", "calibrated")
