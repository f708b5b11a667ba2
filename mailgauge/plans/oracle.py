"""DuckDB SQL for the queries of plans.catalog, from the same fixed values, written apart from the column expressions."""

from __future__ import annotations

import ipaddress

from mailgauge.functions import lexicon as L
from mailgauge.functions.url import PRIVATE_4, PRIVATE_6, PUBLIC_4, PUBLIC_6
from mailgauge.operators.policy import BAD, BAD_COMPACT, GOOD, GOOD_COMPACT
from mailgauge.plans.mail import FETCHED, JSON_MAIL_SQL, LABELS, MAIL_FILES_SQL, PAGES_SQL, PATHS, REQUESTS_SQL, TARGETS_SQL
from mailgauge.plans.mail import MAIL_SQL as SENT_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def total(terms) -> str:
    return "(" + (" + ".join(f"CAST(({t}) AS INTEGER)" for t in terms) or "0") + ")"


def matches(x: str, patterns) -> str:
    return total(f"regexp_matches({x}, {q(p)})" for p in patterns)


def words(x: str, tokens) -> str:
    return total(f"contains({x}, {q(t)})" for t in tokens)


def either(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def named(tests, first: bool = True) -> str:
    """Comma-joined names of the tests that hold, each once, in order."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN {q(n)} END" for n, t in tests) + "], lambda x: x IS NOT NULL), ',')"


def count(x: str, c: str) -> str:
    return f"(length({x}) - length(replace({x}, {q(c)}, '')))"


def canonical(u: str) -> str:
    head = f"regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+)', 1)"
    rest = f"regexp_replace(substr({u}, length({head}) + 1), '#$', '')"
    return f"(CASE WHEN {head} = '' THEN {u} ELSE lower({head}) || regexp_replace({rest}, '^([^?#]*)\\?(#.*)?$', '\\1\\2') END)"


#: Messages, nulls as empty texts.
MAIL_SQL = "SELECT email_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("subject", "text", "sender", "reply_to", "auth", "received", "attachment")) + f" FROM ({SENT_SQL})"
#: Tables that other queries start from.
URLS = f"""
mail AS ({MAIL_SQL}),
found AS (SELECT email_id, unnest(regexp_extract_all(text, '(?i)https?://[^\\s<>()\\[\\]{{}}"'']+')) AS raw, generate_subscripts(regexp_extract_all(text, '(?i)https?://[^\\s<>()\\[\\]{{}}"'']+'), 1) AS n FROM mail),
firsts AS (SELECT email_id, {canonical('raw')} AS url, min(n) AS n FROM found GROUP BY ALL),
urls AS (SELECT email_id, CAST(row_number() OVER (PARTITION BY email_id ORDER BY n) - 1 AS INTEGER) AS pos, url,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1)) AS netloc FROM firsts),
hosts AS (SELECT *, regexp_replace(regexp_replace(netloc, '^.*@', ''), ':[0-9]*$', '') AS host,
          lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') || '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)) AS path_query FROM urls),
labels_of AS (SELECT *, CASE WHEN len(list_filter(string_split(host, '.'), lambda x: x <> '')) < 2 THEN split_part(host, '.', 1)
              ELSE list_filter(string_split(host, '.'), lambda x: x <> '')[-2] END AS label FROM hosts),
brands AS (SELECT *, list_filter([{', '.join(map(q, L.BRANDS))}], lambda b: levenshtein(label, b) = 1 OR (starts_with(label, b) AND regexp_full_match(substr(label, length(b) + 1), '[-_a-z0-9]{{1,8}}'))) AS squat,
           list_filter([{', '.join(map(q, L.BRAND_HINTS))}], lambda b: contains(host, b) AND NOT ends_with(host, b || '.com')) AS hinted FROM labels_of),
"""
_TOKENS = words("host", L.DOMAIN_TOKENS)
_HYPHENS = count("host", "-")
DOMAIN = [
    ("punycode_domain", "contains(host, 'xn--')", "35"),
    ("risky_tld", either(f"ends_with(host, {q(t)})" for t in L.RISKY_TLDS), "20"),
    ("numeric_domain_pattern", "regexp_matches(host, '[0-9]{4,}')", "8"),
    ("excessive_hyphenation", f"{_HYPHENS} >= 2", "10"),
    ("brand_typosquat", "len(squat) > 0", "30"),
    ("credential_theme_domain", f"{_TOKENS} > 0", f"least(30, {_TOKENS} * 6)"),
    ("synthetic_service_domain", f"{_HYPHENS} >= 2 AND {_TOKENS} >= 2 AND length(host) >= 20", "18"),
]
DOMAIN_RISK = "(CASE WHEN host = '' THEN 0 ELSE least(100, " + " + ".join(f"CASE WHEN {t} THEN {n} ELSE 0 END" for _, t, n in DOMAIN) + ") END)"
SUSPICIOUS = f"({words('netloc', (*L.SHORTENERS, 'xn--'))} > 0 OR contains(lower(url), '@') OR regexp_matches(lower(url), 'https?://[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') OR {words('lower(url)', L.URL_TOKENS)} > 0)"
SHORT = either(f"host = {q(d)} OR ends_with(host, {q('.' + d)})" for d in L.SHORTENERS)
LOGIN = f"({words('path_query', L.LOGIN_TOKENS)} > 0)"
_PCT, _ENT, _URL = "'%[0-9A-Fa-f]{2}'", "'&(#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,32});'", "'(?i)https?://[^\\s<>()\\[\\]{}\"'']+'"
#: References that occur in these data, each replaced once; the ampersand last.
_REFERENCES = (("&#104;", "h"), ("&colon;?", ":"), ("&quot;?", '"'), ("&middot;?", "·"), ("&copy;?", "©"), ("&amp;?", "&"))


def unescaped(x: str) -> str:
    for found, char in _REFERENCES:
        x = f"regexp_replace({x}, {q(found)}, {q(char)}, 'g')"
    return x


def decoded64(x: str) -> str:
    """The text of a base64 string of up to 4,000 characters, null for anything else."""
    bare = f"rtrim(translate({x}, '-_', '+/'), '=')"
    looks = f"(regexp_full_match({x}, '[A-Za-z0-9+/]+={{0,2}}') OR regexp_full_match({x}, '[A-Za-z0-9_-]+={{0,2}}'))"
    return f"CASE WHEN length({x}) BETWEEN 16 AND 4000 AND {looks} AND length({bare}) % 4 <> 1 THEN TRY(left(decode(from_base64({bare} || repeat('=', (4 - length({bare}) % 4) % 4))), 600)) END"


#: What the queries of URLs hide.
HIDDEN = f"""
queries AS (SELECT email_id, pos, url, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM urls),
pairs AS (SELECT *, list_filter(string_split(query, '&'), lambda p: p <> '') AS pairs FROM queries),
params AS (SELECT email_id, pos, unnest(pairs[1:30]) AS p, generate_subscripts(pairs[1:30], 1) AS k FROM pairs),
values_of AS (SELECT email_id, pos, k, left(v, 800) AS v, length(v) > 800 AS long FROM (SELECT *, url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' ')) AS v FROM params) WHERE v <> ''),
layer_1 AS (SELECT *, CASE WHEN regexp_matches(v, {_ENT}) THEN {unescaped('v')} ELSE v END AS l1 FROM values_of),
layer_2 AS (SELECT *, CASE WHEN regexp_matches(l1, {_PCT}) THEN url_decode(l1) ELSE l1 END AS l2 FROM layer_1),
layer_3 AS (SELECT *, CASE WHEN regexp_matches(l1, {_PCT}) AND regexp_matches(l2, {_PCT}) THEN url_decode(l2) ELSE l2 END AS l3 FROM layer_2),
coded AS (SELECT *, coalesce({decoded64('l3')}, {decoded64('v')}) AS c, list_transform(regexp_extract_all(l3, {_URL}), lambda u: {canonical('u')}) AS found,
   CASE WHEN l1 <> v THEN ['html_unescape'] ELSE [] END || CASE WHEN l2 <> l1 THEN ['percent_decode'] ELSE [] END || CASE WHEN l3 <> l2 THEN ['percent_decode'] ELSE [] END AS steps FROM layer_3),
spoken AS (SELECT *, coalesce(regexp_matches(c, 'https?://') OR contains(lower(c), '<html'), false) AS speaks FROM coded),
all_found AS (SELECT *, found || CASE WHEN speaks THEN list_transform(regexp_extract_all(c, {_URL}), lambda u: {canonical('u')}) ELSE [] END AS every,
   len(steps) > 0 OR regexp_matches(v, {_PCT}) OR long OR len(found) > 0 OR speaks AS shown FROM spoken),
nested_rows AS (SELECT email_id, pos, u, row_number() OVER (PARTITION BY email_id, pos ORDER BY min(k * 1000 + i)) AS n FROM (SELECT email_id, pos, k, unnest(every) AS u, generate_subscripts(every, 1) AS i FROM all_found) GROUP BY email_id, pos, u),
nested_of AS (SELECT email_id, pos, max(n) AS found, string_agg(u, ',' ORDER BY n) FILTER (WHERE n <= 8) AS nested FROM nested_rows GROUP BY email_id, pos),
samples AS (SELECT *, row_number() OVER (PARTITION BY email_id, pos ORDER BY k) AS place FROM all_found WHERE shown),
shown AS (SELECT email_id, pos, string_agg(array_to_string(steps, ','), ',' ORDER BY k) FILTER (WHERE len(steps) > 0) AS steps, string_agg(left(l3, 600), '|' ORDER BY k) AS texts, string_agg(c, '|' ORDER BY k) AS coded FROM samples WHERE place <= 8 GROUP BY email_id, pos),
per_url AS (SELECT email_id, pos, bool_or(len(found) > 0) AS direct, bool_or(speaks) AS speaks FROM all_found GROUP BY email_id, pos),
hidden AS (SELECT email_id, pos, p.url, least(len(pairs), 30)::INTEGER AS params, regexp_matches(query, {_PCT}) AS encoded, coalesce(direct, false) AS direct, coalesce(speaks, false) AS speaks, len(pairs) > 30 AS capped, coalesce(found, 0) > 8 AS nested_capped,
   coalesce(nested, '') AS nested, coalesce(steps, '') AS steps, coalesce(texts, '') AS texts, coalesce(coded, '') AS coded
   FROM pairs p LEFT JOIN per_url USING (email_id, pos) LEFT JOIN nested_of USING (email_id, pos) LEFT JOIN shown USING (email_id, pos)),
"""
SIGNALS = URLS + HIDDEN + f"""
rated AS (SELECT b.*, {DOMAIN_RISK} AS domain_risk, {SHORT} AS short, {LOGIN} AS login, {SUSPICIOUS.replace("lower(url)", "lower(b.url)")} AS odd, encoded, direct, h.speaks, h.nested, capped, nested_capped FROM brands b JOIN hidden h USING (email_id, pos)),
signals AS (SELECT *, CASE WHEN len(squat) > 0 THEN squat[1] WHEN len(hinted) > 0 THEN hinted[1] ELSE '' END AS brand,
   CASE WHEN len(squat) > 0 THEN 0.92 WHEN len(hinted) > 0 THEN 0.74 ELSE 0.0 END::DOUBLE AS similarity,
   {named([("shortlink", "short"), ("brand-spoof", "len(squat) > 0"), ("login-intent", "login"), ("punycode", "contains(host, 'xn--')"), ("suspicious-pattern", "odd"), ("encoded-query", "encoded"), ("base64-query", "speaks"), ("nested-url-param", "direct"), ("query-redirect", "nested <> ''"), ("brand-spoof", "len(squat) = 0 AND len(hinted) > 0"), ("domain-high-risk", "domain_risk >= 35")])} AS flags,
   least(100, domain_risk + CASE WHEN short THEN 16 ELSE 0 END + CASE WHEN len(squat) > 0 OR len(hinted) > 0 THEN 14 ELSE 0 END + CASE WHEN login THEN 12 ELSE 0 END) AS signal_risk FROM rated)
"""
#: Fixed value: the white space that is taken off at the ends.
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RAW = f"trim(subject || chr(10) || text || chr(10), {_WHITE})"
_SHARE = lambda n: f"least(1.0::DOUBLE, {n} / 3.0::DOUBLE)"
CUE_LISTS = {"urgency": L.URGENCY, "threat": L.THREAT, "payment": L.PAYMENT, "credential": L.CREDENTIAL, "action": L.ACTION, "takeover": L.TAKEOVER}
_S = "lower(subject)"
_ACTS = f"{words(_S, L.SUBJECT_ACTIONS)} > 0"
SUBJECT = (
    f"(CASE WHEN {words(_S, L.SUBJECT_ACCOUNTS)} > 0 AND {_ACTS} THEN 2 ELSE 0 END + "
    + total([f"contains({_S}, 'action required')", f"{words(_S, L.SUBJECT_BRANDS)} > 0 AND {_ACTS}", f"contains({_S}, 'pending') AND contains({_S}, 'message')", f"{count(_S, '!')} >= 2"])
    + ")"
)
_CUE = "|".join(f"(?:{p})" for p in L.URGENCY + L.THREAT + L.CREDENTIAL)
CUES = f"""
lowered AS (SELECT *, lower(subject || chr(10) || text || chr(10)) AS low FROM mail),
cues AS (SELECT *, {', '.join(f"{_SHARE(matches('low', p))} AS {k}" for k, p in CUE_LISTS.items())}, {_SHARE(SUBJECT)} AS subject_risk, {words('low', L.KEYWORDS)} AS keyword_hits,
   {named([(label, f"contains(low, {q(n)})") for n, label in L.IMPERSONATION])} AS roles,
   list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(subject || chr(10) || text || chr(10), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, {_WHITE})),
     lambda x: regexp_matches(lower(x), {q(_CUE)}))[1:4], lambda x: substring(x, 1, 180)) AS highlights FROM lowered)
"""
_AUTH = lambda k: f"coalesce(list_last(regexp_extract_all(lower(auth), '\\b{k}\\s*=\\s*([a-zA-Z_]+)', 1)), 'none')"
_DOMAIN_OF = lambda c: f"regexp_extract(lower({c}), '@([a-z0-9.-]+\\.[a-z]{{2,}})', 1)"
_IP = r"\b(?:127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[0-1])\.)"
HEADERS = f"""
headers AS (SELECT *, {', '.join(f"{_AUTH(k)} AS {k}" for k in ('spf', 'dkim', 'dmarc'))}, starts_with(lower(received), 'received:') AS hop,
   {_DOMAIN_OF('sender')} <> '' AND {_DOMAIN_OF('reply_to')} <> '' AND {_DOMAIN_OF('sender')} <> {_DOMAIN_OF('reply_to')} AS mismatch, regexp_extract(lower(auth), '\\bp=([a-z]+)\\b', 1) AS dmarc_policy FROM mail),
heads AS (SELECT *, {named([("missing_received_headers", "received <> '' AND NOT hop"), ("private_ip_in_received_chain", f"hop AND regexp_matches(received, {q(_IP)})"), ("localhost_received_hop", "hop AND contains(lower(received), 'localhost')")])} AS patterns FROM headers)
"""
_PASSED = " + ".join(f"CAST({k} IN ('pass', 'bestguesspass') AS INTEGER)" for k in ("spf", "dkim", "dmarc"))
_FAILED = " + ".join(f"CAST({k} IN ('fail', 'softfail') AS INTEGER)" for k in ("spf", "dkim", "dmarc"))
_SUFFIX = "lower(regexp_extract(attachment, '[^/.][^/]*(\\.[^./]+)$', 1))"
_LOW_NAME = "trim(lower(attachment))"
_KIND = f"(CASE WHEN {either(f'ends_with({_LOW_NAME}, {q(x)})' for x in L.HIGH_RISK)} THEN 'high_risk' WHEN {either(f'ends_with({_LOW_NAME}, {q(x)})' for x in L.MACROS)} THEN 'macro_risk' ELSE 'low_risk' END)"
_IN = lambda xs: f"{_SUFFIX} IN ({', '.join(map(q, xs))})"
FILES = f"""
kinds AS (SELECT *, {_KIND} AS class, {_IN(L.ARCHIVES)} AS archive, {_IN(L.EXECUTABLES)} AS program FROM mail),
files AS (SELECT *, class = 'macro_risk' AS macro, attachment <> '' AS present,
   {named([("archive", "archive"), ("executable-like", "program"), ("macro-suspected", "class = 'macro_risk'"), ("high-risk-extension", "class = 'high_risk'")])} AS file_flags FROM kinds)
"""
_FLAG_POINTS = {"shortlink": 12, "brand-spoof": 16, "login-intent": 14, "punycode": 10, "suspicious-pattern": 8, "domain-high-risk": 10}
_HAS = lambda f: f"contains(',' || flags || ',', {q(',' + f + ',')})"
_URL_EACH = " + ".join(f"CASE WHEN {_HAS(f)} THEN {n} ELSE 0 END" for f, n in _FLAG_POINTS.items()) + " + CASE WHEN flags <> '' THEN 24 ELSE 0 END + CASE WHEN domain_risk >= 35 THEN 8 ELSE 0 END"
_PRESS = "(threat > 0 OR urgency > 0)"
_ASK = "(credential > 0 OR action > 0)"
_TEXT = f"""least(55, trunc(urgency * 14.0 + threat * 16.0 + payment * 9.0 + credential * 18.0 + action * 10.0 + takeover * 20.0 + subject_risk * 18.0)::INTEGER
   + CASE WHEN keyword_hits > 0 THEN least(24, keyword_hits * 4) ELSE 0 END + CASE WHEN credential > 0 AND {_PRESS} THEN 10 ELSE 0 END
   + CASE WHEN payment > 0 AND {_ASK} THEN 12 ELSE 0 END + CASE WHEN payment > 0 AND {_PRESS} THEN 12 ELSE 0 END + CASE WHEN urgency > 0 AND {_ASK} THEN 8 ELSE 0 END
   + CASE WHEN takeover > 0 AND {_ASK} THEN 8 ELSE 0 END + CASE WHEN roles <> '' AND (credential > 0 OR takeover > 0) THEN 6 ELSE 0 END
   + CASE WHEN subject_risk > 0 AND (credential > 0 OR takeover > 0 OR keyword_hits >= 2) THEN 8 ELSE 0 END
   + CASE WHEN {words("lower(array_to_string(highlights, ' '))", L.PHISHING_WORDS)} > 0 THEN 8 ELSE 0 END)"""
_SPAM_TEXT = "lower(subject || chr(10) || text)"
SPAM = f"least(10, {words(_SPAM_TEXT, L.PROMO)} + {matches(_SPAM_TEXT, L.PROMO_PATTERNS)} + CAST({count(_SPAM_TEXT, '!')} >= 3 AS INTEGER) + CAST(n_urls >= 2 AS INTEGER))"
TRIAGE = SIGNALS + "," + CUES + "," + HEADERS + "," + FILES + f""",
by_mail AS (SELECT email_id, count(*) AS n_urls, sum({_URL_EACH}) AS own, least(24, sum(CASE WHEN login THEN 8 ELSE 0 END)) AS login_points,
   least(20, sum(CASE WHEN brand = '' THEN 0 ELSE trunc(similarity * 100 / 2)::INTEGER END)) AS brand_points, max(least(100, CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END * 14)) AS url_component, max(domain_risk) AS domain_component,
   bool_or({_HAS('shortlink')} OR {_HAS('brand-spoof')} OR {_HAS('login-intent')}) AS url_hit FROM signals GROUP BY email_id),
head_points AS (SELECT email_id, CASE WHEN spf IN ('fail', 'softfail') THEN 16 ELSE 0 END + CASE WHEN dkim = 'fail' THEN 10 ELSE 0 END + CASE WHEN dmarc = 'fail' THEN 16 ELSE 0 END + CASE WHEN mismatch THEN 12 ELSE 0 END
   + CASE WHEN patterns <> '' THEN least(18, 6 * len(string_split(patterns, ','))) ELSE 0 END AS head FROM heads),
scored AS (SELECT c.*, coalesce(n_urls, 0) AS n_urls, coalesce(url_hit, false) AS url_hit, coalesce(url_component, 0) AS url_component, coalesce(domain_component, 0) AS domain_component, f.present, f.file_flags,
   greatest(0, least(100, head + coalesce(least(60, own + login_points) + brand_points, 0) + CASE WHEN present THEN least(35, CASE WHEN macro THEN 18 ELSE 0 END + CASE WHEN program THEN 14 ELSE 0 END) ELSE 0 END + {_TEXT}))::INTEGER AS raw_score
   FROM cues c JOIN head_points USING (email_id) LEFT JOIN by_mail USING (email_id) JOIN files f USING (email_id)),
routed AS (SELECT *, CASE WHEN raw_score <= 30 THEN 'allow' WHEN raw_score <= 70 THEN 'review' ELSE 'deep' END AS route, CASE WHEN raw_score >= 30 THEN 'phishing' ELSE 'benign' END AS verdict,
   CASE WHEN raw_score >= 30 THEN greatest(35, raw_score) ELSE raw_score END AS risk_score, {SPAM} AS spam_score FROM scored),
triage AS (SELECT *, CASE route WHEN 'allow' THEN 'FAST' WHEN 'deep' THEN 'DEEP' ELSE 'STANDARD' END AS path,
   CASE WHEN verdict = 'phishing' OR risk_score >= 35 THEN 'phish_email' WHEN spam_score >= 2 THEN 'spam' ELSE 'benign' END AS email_label,
   trunc((urgency + threat + payment + credential) / 4 * 100)::INTEGER AS text_component, CASE WHEN present AND file_flags <> '' THEN least(100, 15 * len(string_split(file_flags, ','))) ELSE 0 END AS attachment_component FROM routed)
"""
W = "WITH "
SQL = {
    "url_extract": W + URLS.rstrip().rstrip(",") + " SELECT email_id, pos, url FROM urls",
    "url_parts": W + URLS.rstrip().rstrip(",") + f" SELECT email_id, pos, host, label, {SUSPICIOUS} AS suspicious, {SHORT} AS short, {LOGIN} AS login FROM brands",
    "domain_intel": W + URLS.rstrip().rstrip(",") + f" SELECT email_id, pos, host, array_to_string(squat, ',') AS squat, {named([(n, t) for n, t, _ in DOMAIN])} AS indicators, {DOMAIN_RISK} AS risk FROM brands WHERE host <> ''",
    "typosquat_join": W + URLS.rstrip().rstrip(",") + " SELECT email_id, host, unnest(squat) AS brand FROM brands",
    "url_signals": W + SIGNALS + " SELECT email_id, pos, url, brand, similarity, domain_risk, flags, login FROM signals",
    "nlp_cues": f"{W} mail AS ({MAIL_SQL}), {CUES} SELECT email_id, {', '.join(CUE_LISTS)}, subject_risk, keyword_hits, roles FROM cues",
    "highlights": f"{W} mail AS ({MAIL_SQL}), {CUES} SELECT email_id, array_to_string(highlights, '|') AS highlights FROM cues",
    "header_signals": f"{W} mail AS ({MAIL_SQL}), {HEADERS} SELECT email_id, spf, dkim, dmarc, dmarc_policy, mismatch, patterns, round(least(1.0::DOUBLE, 0.35::DOUBLE + 0.15::DOUBLE * ({_PASSED}) + 0.1::DOUBLE * ({_FAILED})), 6) AS confidence FROM heads",
    "attachment_signals": f"{W} mail AS ({MAIL_SQL}), {FILES} SELECT email_id, attachment, class, archive, program, macro, file_flags FROM files WHERE present",
    "triage": W + TRIAGE + " SELECT email_id, raw_score, risk_score, route, path, verdict, spam_score, email_label, text_component, url_component, domain_component, attachment_component FROM triage",
    "triage_summary": W + TRIAGE + " SELECT path, verdict, count(*) AS messages, sum(risk_score) / count(*) AS mean_risk FROM triage GROUP BY path, verdict",
    "context_gates": W + TRIAGE + " SELECT email_id, n_urls > 0 AND (raw_score >= 35 OR url_hit) AS web_requested, present AND (raw_score >= 35 OR contains(file_flags, 'macro-suspected') OR contains(file_flags, 'executable-like')) AS attachment_admitted, "
    "CASE WHEN n_urls > 0 AND (raw_score >= 35 OR url_hit) THEN 'skipped_by_policy' WHEN n_urls = 0 THEN 'skipped_by_signal' ELSE 'skipped_by_score' END AS web_status FROM triage",
    "fusion": W + TRIAGE + " , f AS (SELECT email_id, round_even(text_component * 0.22::DOUBLE + url_component * 0.24::DOUBLE + domain_component * 0.18::DOUBLE + attachment_component * 0.26::DOUBLE + 0 * 0.10::DOUBLE, 0)::INTEGER AS fused FROM triage) "
    "SELECT email_id, fused, CASE WHEN fused >= 70 THEN 'high' WHEN fused >= 35 THEN 'medium' ELSE 'low' END AS level FROM f",
    "judge_merge": W + TRIAGE + """, j AS (SELECT email_id, raw_score AS s, CASE email_id % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'phishing' WHEN 2 THEN 'suspicious' ELSE 'other' END AS judge, (email_id % 10) / 10.0::DOUBLE AS conf FROM triage),
      k AS (SELECT *, CASE WHEN judge = 'other' THEN CASE WHEN s > 34 THEN 'phishing' WHEN s >= 30 THEN 'suspicious' ELSE 'benign' END ELSE judge END AS own FROM j)
      SELECT email_id, judge, CASE WHEN s > 34 THEN 'phishing' WHEN s < 30 AND own = 'phishing' THEN CASE WHEN conf >= 0.75 THEN 'phishing' WHEN conf >= 0.58 THEN 'suspicious' ELSE 'benign' END
        WHEN s < 30 AND own = 'suspicious' AND conf >= 0.58 THEN 'suspicious' WHEN s < 30 AND s >= 20 AND conf < 0.58 THEN 'suspicious' WHEN s < 30 THEN 'benign' ELSE own END AS merged FROM k""",
    "evaluate": W + TRIAGE + """, p AS (SELECT t.verdict = 'phishing' AS p, l.toxic = 1 AS t FROM triage t JOIN labels l ON t.email_id = l.doc_id),
      n AS (SELECT count(*) AS total, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE NOT p AND NOT t) AS tn, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn FROM p)
      SELECT total, tp, tn, fp, fn, (tp + tn) / total AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM n""",
    "sampled_allow": "SELECT doc_id AS email_id, (('0x' || sha256('sample|' || doc_id)[1:8])::BIGINT)::DOUBLE / 4294967295.0::DOUBLE < 0.25 AS sampled FROM documents",
    "evidence_top": W + TRIAGE + """, r AS (SELECT s.email_id, t.path, s.url, row_number() OVER (PARTITION BY s.email_id ORDER BY (CASE WHEN flags = '' THEN 0 ELSE 1 END) DESC, (CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END) DESC, signal_risk + CASE WHEN short THEN 14.5 ELSE 0 END DESC, pos) AS place FROM signals s JOIN triage t USING (email_id))
      SELECT email_id, CAST(place AS INTEGER) AS place, url, 'evd_' || lpad(CAST(place AS VARCHAR), 4, '0') AS evidence_id FROM r WHERE place <= CASE path WHEN 'FAST' THEN 2 WHEN 'STANDARD' THEN 4 ELSE 6 END""",
    "redact": "SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\b([a-z0-9._%+-]{1,2})[a-z0-9._%+-]{0,62}@([a-z0-9.-]+\\.[a-z]{2,})\\b', '\\1***@\\2', 'g'), '\\b[A-Za-z0-9_-]{30,}\\b', '<redacted-token>', 'g') AS redacted FROM documents",
    "html_features": f"{W} p AS ({PAGES_SQL}), b AS (SELECT page_id, lower(html) AS h, html FROM p) SELECT page_id, len(regexp_extract_all(h, '<form[\\s>]')) AS forms, len(regexp_extract_all(h, '<input[^>]*type=.password')) AS passwords, "
    "len(regexp_extract_all(h, '<iframe[\\s>]')) AS iframes, contains(h, 'http-equiv=\"refresh\"') AS refresh, contains(h, 'otp_code') AS otp FROM b",
    "traffic_entropy": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS n, count(*) AS kinds, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY user_id",
    "rate_spike": "WITH c AS (SELECT time_bucket(INTERVAL 1 minute, ts) AS w, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS windows, max(n) AS most, round(avg(n), 6) AS mean, max(n) > 2.0 * avg(n) AS spike FROM c",
    "beacon_cv": "WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events) SELECT user_id, count(gap) AS gaps, round(stddev_pop(gap) / nullif(avg(gap), 0), 6) AS cv FROM g GROUP BY user_id",
    "flag_sets": W + SIGNALS + ", f AS (SELECT email_id, unnest(string_split(flags, ',')) AS flag FROM signals WHERE flags <> '') SELECT email_id, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags, bool_or(flag IN ('shortlink', 'brand-spoof')) AS risky FROM f GROUP BY email_id",
    "fuzzy_match": f"WITH n AS (SELECT DISTINCT host FROM (SELECT lower(regexp_extract(url, '://(?:www\\.)?([^./?#]+)', 1)) AS host FROM pages)), r AS (SELECT host, b, 1 - levenshtein(host, b)::DOUBLE / greatest(length(host), length(b), 1) AS s FROM n, (SELECT unnest([{', '.join(map(q, L.BRANDS))}]) AS b)), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY s DESC, b) AS i FROM r) SELECT host AS name, round(s, 6) AS similarity, CASE WHEN s >= 0.4 THEN b END AS match FROM k WHERE i = 1",
}
_GAPS = "SELECT count(gap) AS gaps, stddev_pop(gap) / nullif(avg(gap), 0) AS cv FROM (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6 AS gap FROM events)"
_SCANS = "WITH c AS (SELECT user_id, regexp_extract(props, '\"k\": (\\d+)', 1) AS port, count(*) AS n, count(*) FILTER (event_type <> 'click') AS opened FROM events GROUP BY ALL), s AS (SELECT user_id, sum(n)::BIGINT AS n, count(*) AS ports, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy, sum(opened)::DOUBLE / sum(n) AS syn_ratio FROM c GROUP BY user_id), p AS (SELECT *, n >= 50 AND entropy > 6 AND syn_ratio > 0.7 AND ports > 100 AS scan FROM s)"
SQL["gap_variation"] = f"SELECT gaps, round(cv, 6) AS cv FROM ({_GAPS})"
SQL["port_scan"] = _SCANS + " SELECT user_id, n, ports, round(entropy, 6) AS entropy, round(syn_ratio, 6) AS syn_ratio, scan FROM p"
SQL["benign_traffic"] = _SCANS + f""", r AS (SELECT time_bucket(INTERVAL 1 minute, ts) AS w, count(*) AS n FROM events GROUP BY 1),
d AS (SELECT (SELECT coalesce(bool_or(scan), false) FROM p) AS port_scan, (SELECT coalesce(max(n) > 20.0 * avg(n), false) FROM r) AS dos, (SELECT coalesce(cv < 0.5, false) FROM ({_GAPS})) AS beaconing)
SELECT *, NOT (port_scan OR dos OR beaconing) AS benign FROM d"""
#: A score's confidence, to two places, by score.
_BY_SCORE = [round(0.35 + r / 100.0 * 0.55, 2) for r in range(101)]
SQL["confidence"] = W + TRIAGE + f""", c AS (SELECT email_id, [{', '.join(f'{x}::DOUBLE' for x in _BY_SCORE)}][risk_score + 1] - least(0.2::DOUBLE, (email_id % 3) * 0.05::DOUBLE) AS c, verdict = 'benign' AND risk_score >= 20 AS unsure FROM triage)
  SELECT email_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round_even((CASE WHEN unsure THEN least(c, 0.62::DOUBLE) ELSE c END) * 100, 0) / 100)) AS confidence FROM c"""
_LOW = "lower(text)"
SQL["route_heuristic"] = W + SIGNALS + f""", u AS (SELECT email_id, count(*) AS n, count(*) FILTER (WHERE odd) AS odd FROM signals GROUP BY email_id),
  m AS (SELECT mail.email_id, coalesce(n, 0) AS n, coalesce(odd, 0) AS odd, attachment <> '' AS f, least(4, {words(_LOW, L.ROUTER_TOKENS)}) + least(3, {words(_LOW, L.ROUTER_URGENCY)}) + least(3, {matches(_LOW, L.ROUTER_ACTIONS)}) AS said FROM mail LEFT JOIN u USING (email_id)),
  p AS (SELECT *, said + least(4, odd * 2) + CASE WHEN n >= 3 THEN 2 ELSE 0 END + CASE WHEN f THEN 2 ELSE 0 END + CASE WHEN f AND n > 0 THEN 1 ELSE 0 END AS points FROM m)
  SELECT email_id, CASE WHEN odd >= 2 OR (f AND n > 0 AND odd > 0) OR points >= 8 THEN 'DEEP' WHEN points >= 3 OR odd > 0 OR f OR n >= 2 THEN 'STANDARD' ELSE 'FAST' END AS path FROM p"""


_LINK = "'(?i)https?://[^\\s<>()\\[\\]{}\"'']+'"
_END, _BASE = "lower(regexp_extract(clean, '[^/.][^/]*(\\.[^./]+)$', 1))", "lower(regexp_replace(clean, '^.*/', ''))"
_ENDS = lambda k: f"{_END} IN ({', '.join(map(q, L.EXPECTED_SUFFIXES[k]))})"
_CLASS = f"CASE WHEN clean = '' THEN 'unknown' WHEN {either(f'ends_with(lower(clean), {q(x)})' for x in L.HIGH_RISK)} THEN 'high_risk' WHEN {either(f'ends_with(lower(clean), {q(x)})' for x in L.MACROS)} THEN 'macro_risk' ELSE 'low_risk' END"
_DEEP = f"""CASE type WHEN 'pdf' THEN least(100, 30 * {words('lower(content)', ('/javascript', '/js'))} + CASE WHEN {words('lower(content)', ('/acform', '/annots'))} > 0 THEN 20 ELSE 0 END + least(20, 4 * len(found)))
  WHEN 'ole' THEN CASE WHEN contains(lower(content), 'vba') THEN 40 ELSE 12 END
  WHEN 'image' THEN least(100, 6 * {words(_BASE, L.IMAGE_NAME_HINTS)} + 14 * {words('lower(ocr_text)', L.IMAGE_TEXT_HINTS)} + 8 * {words('lower(ocr_text)', L.IMAGE_BRANDS)} + CASE WHEN qr_url <> '' THEN 25 ELSE 0 END)
  WHEN 'audio' THEN least(100, 10 * {words(_BASE, L.AUDIO_NAME_HINTS)} + 15 * {words('lower(transcript)', L.AUDIO_TEXT_HINTS)}) WHEN 'unknown' THEN least(40, 8 * len(found)) ELSE 0 END"""
REPORTS = f"""
raw AS ({MAIL_FILES_SQL}),
named AS (SELECT *, trim(name) AS clean, content IS NOT NULL AS known, list_distinct(list_transform(regexp_extract_all(coalesce(content, ''), {_LINK}), lambda u: {canonical('u')})) AS found FROM raw),
typed AS (SELECT *, {_CLASS} AS class, CASE WHEN clean = '' THEN 'unknown' WHEN NOT known THEN 'filename_only' WHEN starts_with(content, '%PDF-') THEN 'pdf' {' '.join(f"WHEN {_ENDS(k)} THEN {q(k)}" for k in ('pdf', 'image', 'audio', 'zip', 'ole', 'html'))} ELSE 'unknown' END AS type FROM named),
listed AS (SELECT *, CASE WHEN clean = '' OR NOT known THEN [] WHEN type IN ('pdf', 'unknown') THEN found WHEN type = 'image' AND qr_url <> '' THEN [qr_url] ELSE [] END AS urls, CASE class WHEN 'low_risk' THEN 8 WHEN 'macro_risk' THEN 55 WHEN 'high_risk' THEN 70 ELSE 10 END AS by_name FROM typed),
rated AS (SELECT *, CAST(CASE WHEN clean = '' THEN 0 WHEN NOT known THEN by_name ELSE least(100, greatest(by_name, {_DEEP})) END AS INTEGER) AS risk_score FROM listed),
reports AS (SELECT email_id, pos, clean AS name, type, risk_score, class, urls, array_to_string(list_filter([CASE WHEN clean = '' THEN 'empty_attachment_name' ELSE 'filename_risk:' || class END, CASE WHEN clean <> '' AND NOT known AND class IN ('high_risk', 'macro_risk') THEN 'extension_high_risk' END,
   CASE WHEN known AND risk_score >= 60 THEN 'attachment_high_risk' END, CASE WHEN len(urls) > 0 THEN 'attachment_contains_url' END, CASE WHEN known AND regexp_matches(clean, '(?i)invoice|payment|login|verify') THEN 'social_engineering_filename' END], lambda x: x IS NOT NULL), ',') AS indicators FROM rated)
"""
_ODD_TYPE = " OR ".join(f"(r.type = {q(k)} AND lower(regexp_extract(s.name, '[^/.][^/]*(\\.[^./]+)$', 1)) NOT IN ({', '.join(map(q, ends))}))" for k, ends in L.EXPECTED_SUFFIXES.items())
_S_END = "lower(regexp_extract(s.name, '[^/.][^/]*(\\.[^./]+)$', 1))"
_S_IN = lambda xs: f"{_S_END} IN ({', '.join(map(q, xs))})"
_STRING = lambda j, k: f"CASE WHEN json_type({j}, '$.{k}') = 'VARCHAR' THEN {j} ->> '$.{k}' END"
_BUDGET = lambda k: "CASE path " + " ".join(f"WHEN {q(n)} THEN {b.get(k, 0)}" for n, b in L.BUDGETS.items()) + " END"
CONTEXT = TRIAGE + f""",
hosted AS (SELECT email_id, host, min(pos) AS pos, min(domain_risk) AS risk, min({total(t for _, t, _ in DOMAIN)}) AS marks FROM signals WHERE host <> '' GROUP BY email_id, host),
domains AS (SELECT email_id, count(*) AS n, arg_min(host, (-risk, -marks, pos)) AS top FROM hosted GROUP BY email_id),
odds AS (SELECT email_id, count(*) AS n FROM signals WHERE flags <> '' GROUP BY email_id),
context AS (SELECT t.email_id, path, CAST(least(n_urls, {_BUDGET('url_signals')}) AS INTEGER) AS urls, CAST(least(CAST(present AS INTEGER), {_BUDGET('attachment_signals')}) AS INTEGER) AS files,
   CAST(least(coalesce(d.n, 0), {_BUDGET('domain_reports')}) AS INTEGER) AS domains, coalesce(d.top, '') AS top_domain, CAST(least(6, coalesce(o.n, 0)) AS INTEGER) AS odd,
   CAST(least(len(list_distinct(list_filter(list_transform(highlights, lambda x: trim(x, {_WHITE})), lambda x: x <> ''))), {_BUDGET('highlights')}) AS INTEGER) AS highlights
   FROM triage t LEFT JOIN domains d USING (email_id) LEFT JOIN odds o USING (email_id)),
refs AS (SELECT email_id, n, p, c FROM (SELECT email_id, unnest([1, 2, 3, 4, 5]) AS n, unnest(['email_context', 'pre_score', 'precheck_summary', 'header_summary', 'nlp_summary']) AS p, unnest(['email', 'pre_score', 'precheck', 'header', 'nlp']) AS c FROM context)
  UNION ALL SELECT email_id, 5 + i, 'selected_url_signals[' || (i - 1) || ']', 'url_signal' FROM (SELECT email_id, unnest(range(1, urls + 1)) AS i FROM context)
  UNION ALL SELECT email_id, 5 + urls + i, 'selected_attachment_signals[' || (i - 1) || ']', 'attachment_signal' FROM (SELECT email_id, urls, unnest(range(1, files + 1)) AS i FROM context)
  UNION ALL SELECT email_id, 5 + urls + files + i, 'selected_domain_reports[' || (i - 1) || ']', 'domain_report' FROM (SELECT email_id, urls, files, unnest(range(1, domains + 1)) AS i FROM context)),
numbered AS (SELECT email_id, 'evd_' || lpad(CAST(n AS VARCHAR), 4, '0') AS evidence_id, p AS evidence_path, c AS category FROM refs)
"""
_KNOWN = "(SELECT * FROM (VALUES " + ", ".join(f"({q(u)}, {h.count('<form')}, {h.count('type=' + chr(34) + 'password')})" for u, h in FETCHED) + ") AS v(url, forms, passwords))"
SQL |= {
    "attachment_reports": W + REPORTS + " SELECT email_id, pos, name, type, risk_score, indicators, len(urls)::INTEGER AS n_urls FROM reports",
    "attachment_bundle": W + REPORTS + """, u AS (SELECT email_id, count(DISTINCT u) AS n FROM (SELECT email_id, unnest(urls) AS u FROM reports) GROUP BY email_id)
      SELECT r.email_id, count(*)::INTEGER AS total, (count(*) FILTER (WHERE risk_score >= 60))::INTEGER AS risky_count, coalesce(string_agg(name, ',' ORDER BY pos) FILTER (WHERE risk_score >= 60), '') AS risky, coalesce(any_value(u.n), 0)::INTEGER AS n_urls FROM reports r LEFT JOIN u USING (email_id) GROUP BY r.email_id""",
    "attachment_enriched": W + REPORTS + f""", last AS (SELECT * FROM reports WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY email_id, name ORDER BY pos DESC) = 1),
      j AS (SELECT s.email_id, s.pos, s.name, s.class, r.type, {_ODD_TYPE} AS odd, r.type = 'ole' AS macro, len(r.urls) > 0 AS linked, {_S_IN(L.ARCHIVES)} AS archive, {_S_IN(L.EXECUTABLES)} AS program FROM reports s JOIN last r ON s.email_id = r.email_id AND s.name = r.name)
      SELECT email_id, pos, name, type, odd AS extension_mismatch, {named([("archive", "archive"), ("executable-like", "program"), ("macro-suspected", "class = 'macro_risk'"), ("high-risk-extension", "class = 'high_risk'"), ("extension-mismatch", "odd"), ("macro-suspected", "macro AND class <> 'macro_risk'"), ("attachment-url-chain", "linked")])} AS flags FROM j""",
    "input_check": f"""WITH r AS ({REQUESTS_SQL}), j AS (SELECT doc_id, CASE WHEN json_valid(raw) AND starts_with(raw, '{{') THEN CAST(raw AS JSON) END AS j FROM r),
      n AS (SELECT *, CASE WHEN json_type(j, '$.attachments') = 'ARRAY' THEN list_transform(CAST(json_extract(j, '$.attachments') AS JSON[]), lambda x: CASE WHEN json_type(x) <> 'OBJECT' THEN '' ELSE trim(coalesce({_STRING('x', 'name')}, {_STRING('x', 'filename')}, '')) END) END AS names FROM j)
      SELECT doc_id, CASE WHEN trim(coalesce({_STRING('j', 'eml_path')}, '')) <> '' THEN 'unsupported_eml_path' WHEN json_type(j, '$.attachments') NOT IN ('ARRAY', 'NULL') THEN 'invalid_attachment_schema'
        ELSE list_filter(list_transform(names, lambda n: CASE WHEN n = '' THEN 'invalid_attachment_schema' WHEN regexp_matches(n, '[/\\\\]') OR starts_with(n, '~') OR n IN ('.', '..') THEN 'unsafe_attachment_path' END), lambda e: e IS NOT NULL)[1] END AS error FROM n""",
    "keyword_scan": f"{W} mail AS ({MAIL_SQL}), k AS (SELECT email_id, {words('lower(text)', L.PHISHING_WORDS)} AS n, {named([(w, f'contains(lower(text), {q(w)})') for w in L.PHISHING_WORDS])} AS matches FROM mail) SELECT email_id, n > 0 AS is_suspicious, matches, n FROM k",
    "stage_chain": W + TRIAGE + " SELECT email_id, raw_score AS risk_score, route, n_urls::INTEGER AS urls FROM triage",
    "score_bands": "WITH s AS (SELECT doc_id, (doc_id % 101)::INTEGER AS s, doc_id % 3 AS v FROM documents) SELECT doc_id, CASE WHEN s > 34 THEN 'phishing' WHEN s >= 30 THEN 'suspicious' ELSE 'benign' END AS verdict, CASE v WHEN 2 THEN greatest(35, s) WHEN 1 THEN greatest(30, least(34, s)) ELSE least(29, s) END AS clamped FROM s",
    "judge_gate": W + TRIAGE + " SELECT email_id, n_urls > 0 AND (route <> 'allow' OR (('0x' || sha256('gate|' || email_id)[1:8])::BIGINT)::DOUBLE / 4294967295.0::DOUBLE < 0.25) AS asked FROM triage",
    "judge_context": W + CONTEXT + " SELECT * FROM context",
    "evidence_refs": W + CONTEXT + " SELECT * FROM numbered",
    "evidence_resolve": W + CONTEXT + """, a AS (SELECT email_id, unnest(['url_signals[0].risk_flags', 'nlp_summary.urgency', 'domain_reports[0]', 'attachment_signals[3]', 'nothing.at.all']) AS path, unnest(['selected_url_signals[0]', 'nlp_summary', 'selected_domain_reports[0]', 'selected_attachment_signals[3]', '']) AS node FROM context)
      SELECT a.email_id, a.path, coalesce(n.evidence_id, '') AS evidence_id FROM a LEFT JOIN numbered n ON a.email_id = n.email_id AND a.node = n.evidence_path""",
    "web_join": W + URLS.rstrip().rstrip(",") + f" SELECT u.email_id, u.pos, u.url, k.url IS NOT NULL AS fetched, coalesce(k.forms, 0) AS forms, coalesce(k.passwords, 0) AS passwords FROM urls u LEFT JOIN {_KNOWN} k ON u.url = k.url WHERE u.pos < 6",
    "run_metrics": W + TRIAGE + """, p AS (SELECT t.verdict = 'phishing' AS p, l.toxic = 1 AS t, risk_score, email_id % 10 = 0 AS f FROM triage t JOIN labels l ON t.email_id = l.doc_id),
      n AS (SELECT count(*) AS total, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND NOT t) AS tn, sum(risk_score) / count(*) AS mean_risk, count(*) FILTER (WHERE f) / count(*) AS fallback_rate FROM p)
      SELECT total, tp, fp, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, mean_risk, fallback_rate FROM n""",
    "balanced_sample": "SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY sha256('balance|' || doc_id), doc_id) <= 20",
}

_DECODED = lambda x: f"url_decode(replace({x}, '+', ' '))"
_ENCODED = lambda x: f"replace(url_encode({x}), '%20', '+')"
_HIDDEN = "CASE WHEN NOT (lower(x.k) IN (" + ", ".join(map(q, sorted(L.TOKEN_KEYS))) + ") OR length(x.v) > 24) THEN x.v WHEN x.v = '' THEN '<redacted>' ELSE '<redacted:' || substring(sha256(x.v), 1, 12) || '>' END"
_MASKED = lambda x: f"regexp_replace({x}, '(?i)\\b([a-z0-9._%+-]{{1,2}})[a-z0-9._%+-]{{0,62}}@([a-z0-9.-]+\\.[a-z]{{2,}})\\b', '\\1***@\\2', 'g')"
SQL["redact_urls"] = W + URLS.rstrip().rstrip(",") + f""",
parts AS (SELECT email_id, pos, regexp_extract(url, '^([^?#]*)', 1) AS base,
   list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> ''),
     lambda p: struct_pack(k := {_DECODED("regexp_extract(p, '^([^=]*)', 1)")}, v := {_DECODED("regexp_extract(p, '^[^=]*=(.*)$', 1)")})) AS pairs FROM urls)
SELECT email_id, pos, {_MASKED(f"CASE WHEN len(pairs) = 0 THEN base ELSE base || '?' || array_to_string(list_transform(pairs, lambda x: {_ENCODED('x.k')} || '=' || {_ENCODED(_HIDDEN)}), '&') END")} AS redacted FROM parts
"""
SQL["evidence_ids"] = f"""
WITH s AS ({SQL["url_signals"]})
SELECT email_id, printf('evd_%04d', row_number() OVER (PARTITION BY email_id ORDER BY pos)) AS evidence_id,
       sha256(CAST(to_json(struct_pack(c := 'url', p := url, s := 'url_intel', t := CASE WHEN flags = '' THEN []::VARCHAR[] ELSE list_sort(string_split(flags, ',')) END)) AS VARCHAR)) AS fingerprint FROM s
"""
_FLAGS = [(n, t) for n, t in (("base64_decoded_query_value", "speaks"), ("nested_url_cap_hit", "nested_capped"), ("nested_url_in_query", "direct"), ("percent_encoded_query", "encoded"), ("query_param_cap_hit", "capped"))]
SQL["url_obfuscation"] = W + URLS + HIDDEN.rstrip().rstrip(",") + f" SELECT email_id, pos, url, params, {named(_FLAGS)} AS flags, nested, steps, texts, coded FROM hidden"
SQL["triage_decoded"] = W + TRIAGE + """,
flags_of AS (SELECT email_id, string_agg(DISTINCT f, ',' ORDER BY f) AS flags FROM (SELECT email_id, unnest(string_split(flags, ',')) AS f FROM signals WHERE flags <> '') GROUP BY email_id),
urls_of AS (SELECT email_id, u, row_number() OVER (PARTITION BY email_id ORDER BY min(pos * 1000 + n)) AS place FROM nested_rows WHERE n <= 8 GROUP BY email_id, u),
lists_of AS (SELECT email_id, max(place) > 20 AS many, string_agg(u, ',' ORDER BY place) FILTER (WHERE place <= 20) AS nested FROM urls_of GROUP BY email_id),
caps AS (SELECT email_id, bool_or(capped) AS capped, bool_or(nested_capped) AS nested_capped FROM hidden GROUP BY email_id)
SELECT t.email_id, raw_score, verdict, coalesce(f.flags, '') AS flags, coalesce(l.nested, '') AS nested, array_to_string(list_filter([CASE WHEN capped THEN 'url_query_param_cap_hit' END, CASE WHEN nested_capped THEN 'url_query_nested_url_cap_hit' END, CASE WHEN many THEN 'query_nested_url_cap_hit' END], lambda x: x IS NOT NULL), ',') AS limits
FROM triage t LEFT JOIN flags_of f USING (email_id) LEFT JOIN lists_of l USING (email_id) LEFT JOIN caps USING (email_id)"""
SQL["text_layers"] = f"""WITH p AS ({PAGES_SQL}), c AS (SELECT page_id, left(html, 12000) AS t, length(html) > 12000 AS input_truncated FROM p),
l1 AS (SELECT *, CASE WHEN regexp_matches(t, {_ENT}) THEN {unescaped('t')} ELSE t END AS a FROM c), l2 AS (SELECT *, CASE WHEN regexp_matches(a, {_PCT}) THEN url_decode(a) ELSE a END AS b FROM l1), l3 AS (SELECT *, CASE WHEN b <> a AND regexp_matches(b, {_PCT}) THEN url_decode(b) ELSE b END AS d FROM l2)
SELECT page_id, array_to_string(CASE WHEN a <> t THEN ['html_unescape'] ELSE [] END || CASE WHEN b <> a THEN ['percent_decode'] ELSE [] END || CASE WHEN d <> b THEN ['percent_decode'] ELSE [] END, ',') AS steps,
  len(regexp_extract_all(t, {_PCT}))::INTEGER AS percent, len(regexp_extract_all(t, {_ENT}))::INTEGER AS entities, md5(d) AS digest, input_truncated FROM l3"""


def _ranges(x: str, nets, show) -> str:
    return either(f"{x} BETWEEN {show(int(n.network_address))} AND {show(int(n.broadcast_address))}" for n in map(ipaddress.ip_network, nets))


_NUMBER = lambda p: f"CASE WHEN {p} LIKE '0x%' THEN {p}::BIGINT WHEN {p} LIKE '0%' THEN list_reduce([0] || list_transform(string_split({p}, ''), lambda d: d::BIGINT), lambda a, d: a * 8 + d) ELSE {p}::BIGINT END"
_V4 = "(0x[0-9a-f]{1,8}|0[0-7]{0,11}|[1-9][0-9]{0,9})"
_DIGITS = lambda n: f"'{n:032x}'"
SQL["fetch_policy"] = W + URLS.rstrip().rstrip(",") + rf""", every AS (SELECT email_id, pos, url FROM urls UNION ALL SELECT * FROM ({TARGETS_SQL})),
a AS (SELECT email_id, pos, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', '') AS place FROM every),
b AS (SELECT *, CASE WHEN starts_with(place, '[') THEN regexp_extract(place, '^\[([^\]]*)\]', 1) ELSE regexp_replace(place, ':[0-9]*$', '') END AS host FROM a),
c AS (SELECT *, CASE WHEN regexp_full_match(host, '{_V4}([.]{_V4}){{0,3}}') THEN list_transform(string_split(host, '.'), lambda p: {_NUMBER('p')}) END AS v4,
   CASE WHEN contains(host, ':') THEN regexp_replace(host, '%.*$', '') END AS bare FROM b),
d AS (SELECT *, CASE WHEN list_max(v4[1:-2]) > 255 OR v4[-1] >= 256 ** (5 - len(v4)) THEN NULL ELSE list_reduce([0::BIGINT] || v4[1:-2], lambda x, y: x * 256 + y) * (256 ** (5 - len(v4)))::BIGINT + v4[-1] END AS n4,
   CASE WHEN regexp_matches(bare, '[0-9]+[.]') THEN regexp_extract(bare, '^(.*:)', 1) || (SELECT printf('%x:%x', x[1] * 256 + x[2], x[3] * 256 + x[4]) FROM (SELECT list_transform(string_split(regexp_extract(bare, '([^:]*)$', 1), '.'), lambda p: TRY_CAST(p AS BIGINT)) AS x)) ELSE bare END AS hex6 FROM c),
e AS (SELECT *, list_filter(string_split(split_part(hex6, '::', 1), ':'), lambda g: g <> '') AS l, CASE WHEN contains(hex6, '::') THEN list_filter(string_split(split_part(hex6, '::', 2), ':'), lambda g: g <> '') ELSE [] END AS r FROM d),
f AS (SELECT *, CASE WHEN len(string_split(hex6, '::')) <= 2 AND (len(l) + len(r) = 8 OR contains(hex6, '::')) THEN array_to_string(list_transform(l || CASE WHEN len(l) + len(r) < 8 THEN list_transform(range(8 - len(l) - len(r)), lambda z: '0') ELSE [] END || r, lambda g: lpad(g, 4, '0')), '') END AS h6 FROM e),
g AS (SELECT *, host = 'localhost' OR ends_with(host, '.localhost') OR coalesce(CASE WHEN n4 IS NOT NULL THEN {_ranges('n4', PRIVATE_4, str)} AND NOT {_ranges('n4', PUBLIC_4, str)} WHEN h6 IS NOT NULL THEN {_ranges('h6', PRIVATE_6, _DIGITS)} AND NOT {_ranges('h6', PUBLIC_6, _DIGITS)} END, false) AS private FROM f)
SELECT email_id, pos, CASE WHEN scheme NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN host = '' THEN 'missing_host' WHEN private THEN 'private_network_blocked' END AS refused, private FROM g"""
_MEMBER = lambda j, k: f"CASE WHEN json_type({j}, '$.{k}') = 'VARCHAR' THEN {j} ->> '$.{k}' ELSE '' END"
_ITEMS = lambda k: f"CASE WHEN json_type(j, '$.{k}') = 'ARRAY' THEN CAST(json_extract(j, '$.{k}') AS JSON[]) ELSE [] END"
_TEXT_OF = lambda x: f"CASE json_type({x}) WHEN 'VARCHAR' THEN {x} ->> '$' WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN CASE WHEN {x}::VARCHAR = 'true' THEN 'True' ELSE 'False' END ELSE {x}::VARCHAR END"
_NAME_OF = f"trim(CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' WHEN 'OBJECT' THEN CASE WHEN {_MEMBER('x', 'name')} <> '' THEN {_MEMBER('x', 'name')} ELSE {_MEMBER('x', 'filename')} END ELSE '' END)"
#: Lists without repeats, in order of first places.
_FIRSTS = lambda x: f"list_filter({x}, lambda v, i: v <> '' AND list_position({x}, v) = i)"
SQL["json_messages"] = f"""WITH m AS ({JSON_MAIL_SQL}),
f AS (SELECT email_id, j, j ->> '$.text' AS text, {_MEMBER('j', 'body_text')} AS body, list_transform({_ITEMS('to')}, lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN trim(x ->> '$') ELSE '' END) AS people,
   list_transform({_ITEMS('attachments')}, lambda x: {_NAME_OF}) AS names, list_transform({_ITEMS('urls')}, lambda x: coalesce(trim({_TEXT_OF('x')}), 'None')) AS given FROM m),
u AS (SELECT *, list_transform(regexp_extract_all(body, {_URL}) || regexp_extract_all(text, {_URL}), lambda u: {canonical('u')}) || given AS links FROM f),
h AS (SELECT email_id, string_agg(key || ': ' || value, chr(10) ORDER BY first) AS lines FROM (SELECT email_id, key, min(n) AS first, arg_max(value, n) AS value FROM
   (SELECT email_id, lower(k) AS key, n, {_TEXT_OF("json_extract(j, '$.headers.\"' || k || '\"')")} AS value FROM (SELECT email_id, j, unnest(json_keys(j, '$.headers')) AS k, generate_subscripts(json_keys(j, '$.headers'), 1) AS n FROM m)) GROUP BY email_id, key) GROUP BY email_id)
SELECT email_id, 'json' AS format, trim({_MEMBER('j', 'subject')}) AS subject, trim({_MEMBER('j', 'sender')}) AS sender, trim({_MEMBER('j', 'date')}) AS date, coalesce(lines, '') AS headers_raw,
  length(CASE WHEN trim(text, {_WHITE}) <> '' THEN text ELSE body END)::INTEGER AS chars, array_to_string({_FIRSTS('people')}, ',') AS "to", '' AS cc, array_to_string({_FIRSTS('links')}, ',') AS urls, array_to_string({_FIRSTS('names')}, ',') AS attachments
FROM u LEFT JOIN h USING (email_id)"""
SQL["json_paths"] = f"""WITH m AS ({JSON_MAIL_SQL}) SELECT email_id, path, CASE WHEN regexp_full_match(path, '[A-Za-z_]\\w*(\\[\\d+\\])*([.][A-Za-z_]\\w*(\\[\\d+\\])*)*') THEN coalesce(json_extract(j, '$.' || path)::VARCHAR, '') ELSE '' END AS value
FROM m, (SELECT unnest([{', '.join(map(q, PATHS))}]) AS path)"""
SQL["json_attachments"] = f"""WITH m AS ({JSON_MAIL_SQL}), x AS (SELECT email_id, unnest({_ITEMS('attachments')}) AS x, generate_subscripts({_ITEMS('attachments')}, 1) - 1 AS pos FROM m) SELECT email_id, pos::INTEGER AS pos, {_NAME_OF} AS name FROM x"""
_RAW_URLS = f"(SELECT email_id, count(*) AS n FROM urls GROUP BY email_id)"
SQL["message_parse"] = W + URLS + f"""
raw AS (SELECT email_id, CASE WHEN s.text IS NULL OR (email_id % 4 <> 3 AND email_id % 4 <> 1 AND s.subject IS NULL) OR (email_id % 4 = 0 AND s.sender IS NULL) THEN 'none' ELSE CASE email_id % 4 WHEN 0 THEN 'eml' WHEN 1 THEN 'json' WHEN 2 THEN 'header_block' ELSE 'text' END END AS kind, s.subject, s.sender, s.text FROM ({SENT_SQL}) s),
k AS (SELECT *, CASE WHEN kind = 'none' AND email_id % 4 = 1 THEN 'json' WHEN kind = 'none' THEN 'empty' ELSE kind END AS format FROM raw)
SELECT k.email_id, format, CASE WHEN format IN ('empty', 'text') THEN '' ELSE coalesce(subject, '') END AS subject, CASE WHEN format IN ('eml', 'json') THEN coalesce(sender, '') ELSE '' END AS sender,
  CASE WHEN text IS NULL OR format = 'empty' THEN 0 ELSE coalesce(n, 0) END::INTEGER AS urls,
  length(CASE format WHEN 'empty' THEN '' WHEN 'text' THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) WHEN 'header_block' THEN trim('Subject: ' || subject || chr(10) || chr(10) || text, {_WHITE}) ELSE coalesce(text, '') END)::INTEGER AS chars, NULL::VARCHAR AS parse_error
FROM k LEFT JOIN {_RAW_URLS} u USING (email_id)"""
SQL["mime_parts"] = f"""WITH m AS ({MAIL_SQL}), p AS (SELECT email_id, 0 AS part, 1 AS depth, 'text/plain' AS content_type, '' AS name, '' AS disposition, text AS body FROM m
  UNION ALL SELECT email_id, 1, 2, 'text/html', '', '', subject FROM m
  UNION ALL SELECT m.email_id, 2, 1, 'application/pdf', CASE WHEN s.attachment IS NULL THEN 'none' ELSE s.attachment END, 'attachment', m.sender FROM m JOIN ({SENT_SQL}) s USING (email_id))
SELECT email_id, part, depth, content_type, name, disposition, octet_length(encode(body))::BIGINT AS size, sha256(body) AS sha256, CASE WHEN part < 2 THEN length(body)::INTEGER END AS chars FROM p"""
SQL["archive_reports"] = W + URLS + """
n AS (SELECT email_id, count(*) AS n, string_agg(url, ',' ORDER BY pos) AS urls FROM urls GROUP BY email_id)
SELECT m.email_id, CASE WHEN m.email_id % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS members, m.email_id % 3 = 0 AS macro_like, CASE WHEN m.email_id % 3 = 0 THEN 'word/vbaProject.bin' ELSE '' END AS entries, coalesce(urls, '') AS urls, '' AS skipped,
  (CASE WHEN m.email_id % 3 = 0 THEN 40 ELSE 0 END + least(20, 4 * coalesce(n, 0)))::INTEGER AS risk_score FROM mail m LEFT JOIN n USING (email_id)"""
_SHOWN = "trim(regexp_replace(" + unescaped("regexp_replace(b, '<[^>]*>', '', 'g')") + ", '\\s+', ' ', 'g'))"
SQL["page_anchors"] = f"""WITH p AS ({PAGES_SQL}), a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>'), 1) - 1 AS pos FROM p),
b AS (SELECT page_id, pos::INTEGER AS pos, trim({unescaped("regexp_extract(a, 'href=" + chr(34) + "([^" + chr(34) + "]*)', 1)")}) AS href, regexp_extract(a, '(?s)^<a[^>]*>(.*)</a>$', 1) AS b FROM a),
c AS (SELECT *, {_SHOWN} AS shown FROM b)
SELECT page_id, pos, href, shown, len(list_filter(list_transform(regexp_extract_all(shown, {_URL}), lambda u: lower(regexp_extract(u, '//([^/?#]*)', 1))), lambda o: o <> '' AND o <> lower(regexp_extract(href, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//([^/?#]*)', 1)))) > 0 AS hides FROM c"""
_FILE_MARKS = f"CASE WHEN attachment = '' THEN 1 ELSE 1 + CASE WHEN class IN ('high_risk', 'macro_risk') THEN 1 ELSE 0 END END"
SQL["sql_tools"] = W + SIGNALS + "," + FILES + rf""",
paths AS (SELECT * FROM ({SQL["route_heuristic"]})),
of_mail AS (SELECT email_id, count(*) AS n FROM signals GROUP BY email_id),
gate AS (SELECT email_id, refused FROM ({SQL["fetch_policy"]}) WHERE pos = 0),
firsts_of AS (SELECT s.*, refused, (encoded OR direct OR speaks OR capped OR nested_capped) AS hides FROM signals s JOIN gate USING (email_id) WHERE s.pos = 0)
SELECT m.email_id, length(trim(regexp_replace(m.text, '\s+', ' ', 'g')))::INTEGER AS chars, {words('lower(m.text)', L.PHISHING_WORDS)} AS words, path, coalesce(n, 0)::INTEGER AS urls, odd,
  CASE WHEN m.attachment = '' THEN 'unknown' ELSE k.class END AS file_risk, 'header_block' AS format, f.host AS domain, coalesce(f.domain_risk, 0) AS domain_risk, CASE WHEN f.email_id IS NULL OR refused IS NOT NULL THEN 'blocked' ELSE 'not_fetched' END AS status,
  (CASE WHEN f.email_id IS NULL OR refused IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN hides THEN 6 ELSE 0 END)::INTEGER AS target_risk, ({_FILE_MARKS.replace('attachment', 'm.attachment').replace('class', 'k.class')})::INTEGER AS marks
FROM mail m JOIN paths USING (email_id) JOIN files k USING (email_id) LEFT JOIN of_mail USING (email_id) LEFT JOIN firsts_of f USING (email_id)"""
_BLOCK = "list_filter(flatten(list_transform(range(least(length(a), length(b)), 0, -1), lambda n: list_transform(range(1, length(a) - n + 2), lambda i: [n, i]))), lambda s: contains(b, substr(a, s[2], s[1])))[1]"
SQL["close_matches"] = "WITH RECURSIVE " + URLS + f"""
names AS (SELECT DISTINCT lower(regexp_extract(url, '://(?:www\\.)?([^./?#]+)', 1)) AS name FROM pages),
known AS (SELECT unnest([{', '.join(map(q, L.BRANDS))}]) AS word UNION SELECT lower(regexp_extract(url, '://(?:www\\.)?([^./?#]+)', 1)) FROM urls),
pairs AS (SELECT row_number() OVER () AS id, name, word FROM names, known WHERE name <> '' AND word <> ''),
parts AS (SELECT id, word AS a, name AS b, 0::BIGINT AS n FROM pairs
  UNION ALL SELECT id, unnest([substr(a, 1, s[2] - 1), substr(a, s[2] + s[1])]), unnest([substr(b, 1, instr(b, substr(a, s[2], s[1])) - 1), substr(b, instr(b, substr(a, s[2], s[1])) + s[1])]), unnest([s[1], 0])
  FROM (SELECT id, a, b, {_BLOCK} AS s FROM parts) WHERE s IS NOT NULL),
rated AS (SELECT p.name, p.word, 2.0::DOUBLE * sum(n)::DOUBLE / (length(p.name) + length(p.word)) AS ratio FROM parts JOIN pairs p USING (id) GROUP BY id, p.name, p.word)
SELECT name, place, word AS match, round(ratio, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio DESC, word DESC)::INTEGER AS place FROM rated WHERE ratio >= 0.4) WHERE place <= 3"""


def _profile(k: int, review: int, deep: int, weight: int, low: int, high: int) -> str:
    """The triage of every third message by its profile's values."""
    sql = TRIAGE.replace("WHEN flags <> '' THEN 24 ELSE 0 END", f"WHEN flags <> '' THEN {weight} ELSE 0 END").replace("raw_score <= 30 THEN 'allow' WHEN raw_score <= 70", f"raw_score <= {review} THEN 'allow' WHEN raw_score <= {deep}")
    sql = sql.replace("CASE WHEN raw_score >= 30 THEN 'phishing'", f"CASE WHEN raw_score >= {low} THEN 'phishing'").replace("CASE WHEN raw_score >= 30 THEN greatest(35, raw_score)", f"CASE WHEN raw_score >= {low} THEN greatest(35, raw_score)")
    return f"SELECT * FROM (WITH {sql} SELECT email_id, raw_score, risk_score, route, verdict FROM triage WHERE email_id % 3 = {k})"


SQL["triage_profiles"] = " UNION ALL ".join([_profile(0, 20, 40, 34, 15, 19), _profile(1, 50, 65, 24, 45, 49), _profile(2, 30, 65, 24, 30, 34)])
_LABEL = "lower(trim(text))"
SQL["label_values"] = f"""WITH d AS (SELECT doc_id, source, [{', '.join(map(q, LABELS))}][doc_id % {len(LABELS)} + 1] AS text FROM documents), c AS (SELECT *, {_LABEL} AS l, regexp_replace({_LABEL}, '[^a-z0-9]', '', 'g') AS k FROM d)
SELECT doc_id, text, CASE WHEN l IN ({', '.join(map(q, BAD))}) THEN 1 WHEN l IN ({', '.join(map(q, GOOD))}) OR k IN ({', '.join(map(q, GOOD_COMPACT))}) THEN 0 WHEN k IN ({', '.join(map(q, BAD_COMPACT))}) THEN 1 WHEN contains(l, 'safe') THEN 0
  WHEN regexp_matches(l, 'phish|malicious|spam') THEN 1 END AS label, l IN ('1', 'true', 'yes', 'on') AS truth, CASE WHEN regexp_full_match(l, '[0-9]+') AND l <> '0' THEN l::INTEGER ELSE 8 END AS n, coalesce(TRY_CAST(l AS DOUBLE), -1.0::DOUBLE) AS x,
  array_to_string({_FIRSTS("list_transform(string_split(array_to_string([source, text, source, ' '], ','), ','), lambda v: trim(v))")}, '|') AS choices FROM c"""
SQL["judge_join"] = W + TRIAGE + """, v AS (SELECT doc_id AS email_id, CASE WHEN toxic = 1 AND doc_id % 5 <> 0 THEN 'phishing' WHEN quality = 1 THEN 'benign' ELSE 'suspicious' END AS judge, (doc_id % 10) / 10.0::DOUBLE AS conf FROM labels),
m AS (SELECT email_id, raw_score AS s, judge, conf, CASE WHEN judge IS NULL THEN verdict WHEN raw_score > 34 THEN 'phishing' WHEN raw_score < 30 AND judge = 'phishing' THEN CASE WHEN conf >= 0.75 THEN 'phishing' WHEN conf >= 0.58 THEN 'suspicious' ELSE 'benign' END
  WHEN raw_score < 30 AND judge = 'suspicious' AND conf >= 0.58 THEN 'suspicious' WHEN raw_score < 30 AND raw_score >= 20 AND conf < 0.58 THEN 'suspicious' WHEN raw_score < 30 THEN 'benign' ELSE judge END AS final_verdict, risk_score FROM triage LEFT JOIN v USING (email_id))
SELECT email_id, s AS raw_score, judge, CASE WHEN judge IS NULL THEN 'deterministic' ELSE 'judge' END AS decided_by, final_verdict,
  CASE WHEN judge IS NULL THEN risk_score WHEN final_verdict = 'phishing' THEN greatest(35, s) WHEN final_verdict = 'suspicious' THEN greatest(30, least(34, s)) ELSE least(29, s) END AS final_score FROM m"""
SQL["hidden_links"] = f"""SELECT DISTINCT page_id, href FROM ({SQL["page_anchors"]}) WHERE hides"""
_CHAIN = "CASE WHEN n_urls > 0 OR present THEN 1 ELSE 0 END"
SQL["validate"] = W + TRIAGE + f""" SELECT email_id, CASE WHEN verdict = 'phishing' AND raw_score = 0 AND {_CHAIN} = 0 THEN 'missing_indicators' ELSE '' END AS issues FROM triage"""
_PHISH = "lower(trim(v)) = 'phishing'"
SQL["result_issues"] = W + TRIAGE + f""", b AS (SELECT email_id, CASE email_id % 7 WHEN 0 THEN 'odd' WHEN 1 THEN ' Phishing ' WHEN 2 THEN '' ELSE verdict END AS v, CASE email_id % 5 WHEN 0 THEN 999 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 41 ELSE risk_score END AS n,
   email_id % 3 = 0 OR (raw_score = 0 AND {_CHAIN} = 0) AS silent, email_id % 4 = 0 AS bare FROM triage)
SELECT email_id, {named([("invalid_verdict", "lower(trim(v)) NOT IN ('benign', 'phishing', 'suspicious')"), ("invalid_risk_score_type", "n IS NULL"), ("invalid_risk_score_range", "coalesce(n, -1) NOT BETWEEN 0 AND 100"), ("missing_indicators", f"{_PHISH} AND silent"), ("missing_evidence", f"{_PHISH} AND bare")])} AS issues FROM b"""
