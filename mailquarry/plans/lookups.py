"""Look-up snapshots for the queries, derived from the links, domains and addresses of the mails.

Plain SQL again, equal for Spark and DuckDB. Values come from digits of md5, coverage is partial.
"""

from __future__ import annotations

AS_OF = "2024-06-01"


def digit(column: str, i: int) -> str:
    """i-th hex digit of the md5 of a column as a number."""
    return f"(instr('0123456789abcdef', substr(md5({column}), {i}, 1)) - 1)"


def _int(e: str) -> str:
    return f"CAST({e} AS INT)"


def _rep(key: str) -> str:
    d = lambda i: digit(key, i)
    return f"""SELECT {key}, {_int(f"CASE WHEN {d(1)} < 4 THEN {d(2)} % 5 ELSE 0 END")} AS malicious,
      {_int(f"CASE WHEN {d(4)} < 5 THEN {d(5)} % 3 ELSE 0 END")} AS suspicious, {_int(f"{d(6)} * 4")} AS clean,
      {_int(f"{d(7)} - 8")} AS reputation FROM {{src}} WHERE {d(3)} < 10"""


URL_REP = _rep("url")
DOMAIN_REP = _rep("domain")
BLOCKLIST = f"""SELECT url, 'SOCIAL_ENGINEERING' AS threat FROM {{src}} WHERE {digit('url', 8)} = 3
  UNION ALL SELECT url, 'MALWARE' AS threat FROM {{src}} WHERE {digit('url', 8)} = 3 AND {digit('url', 9)} < 8"""
MALWARE_URLS = f"SELECT url, {_int(f'CASE WHEN {digit("url", 10)} < 2 THEN 1 ELSE 0 END')} AS listed FROM {{src}} WHERE {digit('url', 11)} < 12"
URL_SCAN = f"""SELECT url, {_int(f"CASE WHEN {digit('url', 12)} < 2 THEN 1 ELSE 0 END")} AS malicious,
  {_int(f"CASE WHEN {digit('url', 13)} < 3 THEN 1 ELSE 0 END")} AS brand, {_int(f"{digit('url', 14)} % 4")} AS redirects
  FROM {{src}} WHERE {digit('url', 15)} < 9"""
IP_REP = f"""SELECT ip, {_int(f"{digit('ip', 1)} * 6")} AS score, {_int(f"{digit('ip', 2)} * 3")} AS reports,
  {_int(f"CASE WHEN {digit('ip', 3)} = 0 THEN 1 ELSE 0 END")} AS is_tor FROM {{src}} WHERE {digit('ip', 4)} < 11"""
FRAUD_REP = f"""SELECT kind, item AS key, {_int(f"{digit('item', 16)} * 6")} AS score,
  {_int(f"CASE WHEN {digit('item', 17)} = 1 THEN 1 ELSE 0 END")} AS flagged FROM {{src}} WHERE {digit('item', 18)} < 9"""
DNS_TXT = f"""SELECT domain, 'spf' AS kind, '' AS selector, CASE {digit('domain', 1)} % 4 WHEN 0 THEN 'v=spf1 -all' WHEN 1 THEN 'V=SPF1 ~all'
    WHEN 2 THEN 'v=spf1 include:x' ELSE 'other text' END AS txt FROM {{src}} WHERE {digit('domain', 2)} < 13
  UNION ALL SELECT domain, 'dkim', CASE {digit('domain', 3)} % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'k1' ELSE 'custom' END, 'k=rsa' FROM {{src}} WHERE {digit('domain', 4)} < 10
  UNION ALL SELECT domain, 'dmarc', '', CASE {digit('domain', 5)} % 4 WHEN 0 THEN 'v=DMARC1; p=reject' WHEN 1 THEN 'v=DMARC1; p=quarantine'
    WHEN 2 THEN 'v=DMARC1; p=none' ELSE 'x' END FROM {{src}} WHERE {digit('domain', 6)} < 12"""
WHOIS = f"""SELECT domain, DATE '{AS_OF}' - {_int(f"{digit('domain', 1)} * 9 + {digit('domain', 2)}")} AS created,
  CASE {digit('domain', 3)} % 3 WHEN 0 THEN 'GoDaddy LLC' WHEN 1 THEN 'Nice Names' ELSE 'NAMECHEAP INC' END AS registrar
  FROM {{src}} WHERE {digit('domain', 4)} < 10"""
CERT_LOG = " UNION ALL ".join(f"""SELECT domain, {n} AS entry_no, CAST(DATE '{AS_OF}' - {_int(f"{digit('domain', 7)} * {n} * 5 + 1")} AS TIMESTAMP) AS not_before,
  CASE WHEN {digit('domain', 8)} < 6 THEN 'C=US, O=Lets Encrypt' ELSE 'C=US, O=Some CA' END AS issuer,
  CASE WHEN {digit('domain', 9)} + {n} < 5 THEN 'login.paypal.' || domain ELSE 'www.' || domain END AS san
  FROM {{src}} WHERE {digit('domain', 10)} < 11""" for n in (1, 2, 3))
REDIRECT_MAP = f"""SELECT url, CASE {digit('url', 1)} % 4 WHEN 0 THEN 'http://landed' || substr(md5(url), 1, 2) || '.example.xyz/login'
    WHEN 1 THEN 'https://track.example.com/r?dest=http%3A%2F%2Ffinal.example.top%2Fz' WHEN 2 THEN 'ftp://nowhere' ELSE 'https://bit.ly/again' || substr(md5(url), 1, 1) END AS location
  FROM {{src}} WHERE url LIKE 'https://bit.ly/%' OR url LIKE 'https://t.co/%' OR url LIKE '%mimecast%' OR url LIKE 'https://tinyurl%'"""
AI_ANSWER = """SELECT mail_id, CASE mail_id % 6
    WHEN 0 THEN '{{"is_phishing": true, "confidence": 0.91, "risk_level": "HIGH", "impersonated_brand": "PayPal", "phishing_signals": ["a", "b"], "recommended_action": "BLOCK"}}'
    WHEN 1 THEN '{{"is_phishing": false, "confidence": 0.88, "risk_level": "LOW", "impersonated_brand": null, "phishing_signals": []}}'
    WHEN 2 THEN '{{"is_phishing": true, "confidence": 0.5}}' WHEN 3 THEN '{{"is_phishing": tr' ELSE '{{"is_phishing": false, "confidence": 0.7, "recommended_action": "ALLOW"}}' END AS answer
  FROM {src} WHERE mail_id % 5 <> 4"""
_HIT = "CASE WHEN doc_id % 3 = 2 OR doc_id % 9 = 0 THEN 1 ELSE 0 END"
SCORED = " UNION ALL ".join(
    f"""SELECT doc_id AS mail_id, '{m}' AS model, CAST({_HIT} AS INT) AS label, CAST((doc_id * {f} + {o}) % 700 + {_HIT} * {g} AS DOUBLE) / 1000 AS prob,
    source FROM {{src}}""" for m, f, o, g in (("gbt", 37, 11, 250), ("lr", 53, 5, 200), ("rf", 71, 2, 230)))
ALLOWLIST = """SELECT DISTINCT domain FROM {src} WHERE """ + digit("domain", 1) + " < 8"
COEF = [("hdr_from_reply_to_mismatch", 0.8, 0.4), ("hdr_spf_result", -0.6, 0.1), ("hdr_received_hop_count", 0.05, 3.5), ("url_url_count", 0.04, 3.0),
        ("url_tld_risk_score_max", 1.1, 0.3), ("url_path_depth_mean", 0.2, 1.2), ("html_total_links", 0.02, 2.0), ("txt_urgency_phrase_count", 0.5, 0.8),
        ("txt_subject_length", 0.01, 17.0), ("url_is_ip_address_max", 1.7, 0.1)]
# Six trees of depth two over these features, by rule: thresholds at the means, leaves in steps of a twentieth.
TREES = [row for t in range(6) for row in (
    *((t, n, COEF[(t + 3 * n) % len(COEF)][0], COEF[(t + 3 * n) % len(COEF)][2], 2 * n + 1, 2 * n + 2, 0.0) for n in range(3)),
    *((t, n, None, None, -1, -1, ((7 * t + 3 * n) % 11 - 5) / 20) for n in range(3, 7)))]
COEF_ROWS = ", ".join(f"('{n}', CAST({c} AS DOUBLE), CAST({m} AS DOUBLE))" for n, c, m in COEF)
