"""URL extraction, parts and risk: built-in column expressions only."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgauge.functions import lexicon as L
from mailgauge.functions.text import any_keyword, bind, keyword_hits, keywords_found, strip

URL_PATTERN = r"(?i)https?://[^\s<>()\[\]{}\"']+"


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def canonicalize(url: Column) -> Column:
    """Scheme and authority in lower case, an empty query or fragment dropped."""
    u = strip(url)
    head = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1)
    rest = F.regexp_replace(F.substring(u, F.length(head) + 1, F.length(u)), r"#$", "")
    return F.when(head == "", u).otherwise(F.concat(F.lower(head), F.regexp_replace(rest, r"^([^?#]*)\?(#.*)?$", "$1$2")))


def extract_urls(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL_PATTERN), F.lit(0)), canonicalize))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def hostname(url: Column) -> Column:
    """The authority without user, port and the brackets of an IPv6 address."""
    bare = lambda a: F.when(a.startswith("["), F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(a, r":\d*$", ""))
    return bind(F.regexp_replace(netloc(url), r"^.*@", ""), bare)


def path_query(url: Column) -> Column:
    """Path, without parameters of its last part, ``?`` and query."""
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(F.regexp_replace(rest, r";[^/]*$", ""), F.lit("?"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))


def base_domain(host: Column) -> Column:
    last = lambda parts: F.when(F.size(parts) < 2, host).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "."))
    return bind(F.filter(F.split(host, r"\."), lambda x: x != ""), last)


def is_suspicious(url: Column) -> Column:
    domain = lambda raw: bind(netloc(raw), lambda d: any_keyword(d, (*L.SHORTENERS, "xn--")))
    odd = lambda raw: domain(raw) | raw.contains("@") | raw.rlike(r"https?://\d{1,3}(?:\.\d{1,3}){3}") | any_keyword(raw, L.URL_TOKENS)
    return bind(F.lower(canonicalize(url)), odd)


def is_shortlink(host: Column) -> Column:
    return any_of([(host == d) | host.endswith(f".{d}") for d in L.SHORTENERS])


def has_login_words(url: Column) -> Column:
    return bind(F.lower(path_query(url)), lambda path: any_keyword(path, L.LOGIN_TOKENS))


def typosquat_brands(host: Column) -> Column:
    """Brands one edit away from the base domain's first label, or its prefix before at most 8 more characters."""
    suffix = lambda label, b: F.substring(label, F.length(b) + 1, F.length(label))
    near = lambda label: lambda b: (F.levenshtein(label, b, 1) == 1) | (label.startswith(b) & suffix(label, b).rlike(r"^[-_a-z0-9]{1,8}$"))
    return bind(F.substring_index(base_domain(host), ".", 1), lambda label: F.filter(F.array(*map(F.lit, L.BRANDS)), near(label)))


def hyphens(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))


def domain_tests(host: Column, squats: Column, tokens: Column) -> list[tuple[str, Column, Column]]:
    """(indicator, test, points) of a host with its look-alike brands and its number of credential words, in order."""
    return [
        ("punycode_domain", host.contains("xn--"), F.lit(35)),
        ("risky_tld", any_of([host.endswith(t) for t in L.RISKY_TLDS]), F.lit(20)),
        ("numeric_domain_pattern", host.rlike(r"\d{4,}"), F.lit(8)),
        ("excessive_hyphenation", hyphens(host) >= 2, F.lit(10)),
        ("brand_typosquat", F.size(squats) > 0, F.lit(30)),
        ("credential_theme_domain", tokens > 0, F.least(F.lit(30), tokens * 6)),
        ("synthetic_service_domain", (hyphens(host) >= 2) & (tokens >= 2) & (F.length(host) >= 20), F.lit(18)),
    ]


def domain_risk(host: Column) -> Column:
    return bind(typosquat_brands(host), lambda squats: _risk(host, squats))


def _risk(host: Column, squats: Column) -> Column:
    points = lambda tokens: sum((F.when(test, n).otherwise(0) for _, test, n in domain_tests(host, squats, tokens)), F.lit(0))
    return F.when(host == "", 0).otherwise(F.least(F.lit(100), bind(keyword_hits(host, L.DOMAIN_TOKENS), points)))


def domain_indicators(host: Column) -> Column:
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test, _ in domain_tests(host, typosquat_brands(host), keyword_hits(host, L.DOMAIN_TOKENS))])))


def suspicious_tokens(host: Column) -> Column:
    return keywords_found(host, L.DOMAIN_TOKENS)


#: round(0.35 + risk / 100 * 0.55 + bonus, 2) of each risk, as Python's round gives it.
def confidence(risk: Column, bonus: float = 0.0) -> Column:
    values = [max(0.0, min(1.0, round(0.35 + (r / 100.0) * 0.55 + bonus, 2))) for r in range(101)]
    return F.get(F.array(*map(F.lit, values)), risk)


#: Flags of a signal by the flags of its decoded query.
QUERY_FLAGS = (("encoded-query", "percent_encoded_query"), ("base64-query", "base64_decoded_query_value"), ("nested-url-param", "nested_url_in_query"))


def url_signal(url: Column, high_domain: int = 35, hidden: Column | None = None) -> Column:
    """The signal of one URL, as a struct: parts, brand, domain risk, flags in order, confidence and nested URLs.

    ``hidden``: what ``decode`` found in its query, a struct with flags and nested; without it the query isn't decoded.
    """
    return bind(hostname(url), lambda host: bind(_facts(url, host), lambda facts: _signal(url, host, facts, high_domain, hidden)))


def nested_urls(signals: Column) -> Column:
    """Distinct URLs in the queries of all signals of a message, in order."""
    return F.array_distinct(F.flatten(F.transform(signals, lambda s: s["nested_urls"])))


def _facts(url: Column, host: Column) -> Column:
    hinted = F.filter(F.array(*map(F.lit, L.BRAND_HINTS)), lambda b: host.contains(b) & ~host.endswith(F.concat(b, F.lit(".com"))))
    both = lambda squat: F.struct(squat.alias("squat"), _risk(host, squat).alias("risk"), hinted.alias("hinted"), has_login_words(url).alias("login"), is_shortlink(host).alias("short"), is_suspicious(url).alias("odd"))
    return bind(typosquat_brands(host), both)


def _query_flags(hidden: Column | None) -> list[tuple[str, Column]]:
    if hidden is None:
        return []
    return [*((name, F.array_contains(hidden["flags"], found)) for name, found in QUERY_FLAGS), ("query-redirect", F.size(hidden["nested"]) > 0)]


def _signal(url: Column, host: Column, facts: Column, high_domain: int, hidden: Column | None) -> Column:
    squat, risk, hinted, login, short = (facts[k] for k in ("squat", "risk", "hinted", "login", "short"))
    squats, hints = F.size(squat) > 0, F.size(hinted) > 0
    flags = [("shortlink", short), ("brand-spoof", squats), ("login-intent", login), ("punycode", host.contains("xn--")), ("suspicious-pattern", facts["odd"]), *_query_flags(hidden), ("brand-spoof", ~squats & hints), ("domain-high-risk", risk >= high_domain)]
    total = F.least(F.lit(100), risk + F.when(short, 16).otherwise(0) + F.when(squats | hints, 14).otherwise(0) + F.when(login, 12).otherwise(0))
    return F.struct(
        url.alias("url"),
        host.alias("final_domain"),
        short.alias("is_shortlink"),
        host.contains("xn--").alias("is_punycode"),
        F.when(squats, F.get(squat, F.lit(0))).when(hints, F.get(hinted, F.lit(0))).otherwise("").alias("brand"),
        F.when(squats, 0.92).when(hints, 0.74).otherwise(0.0).alias("similarity"),
        risk.alias("domain_risk"),
        login.alias("has_login_keywords"),
        F.array_distinct(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags]))).alias("risk_flags"),
        F.when(short, confidence(total, 0.08)).otherwise(confidence(total)).alias("confidence"),
        (F.array().cast("array<string>") if hidden is None else hidden["nested"]).alias("nested_urls"),
        (F.array().cast("array<string>") if hidden is None else hidden["flags"]).alias("query_flags"),
    )


#: Ranges of addresses that aren't public: private, local, multicast, documentation and reserved ones.
PRIVATE_4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
PRIVATE_6 = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
#: Public addresses and ranges inside those.
PUBLIC_4 = ("192.0.0.9/32", "192.0.0.10/32")
PUBLIC_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def ipv4(host: Column) -> Column:
    """The number of an IPv4 address as a resolver reads it: one to four decimal, octal or hexadecimal parts, the last of which fills the rest; null for anything else."""
    part = r"(?:0x[0-9a-f]{1,8}|0[0-7]{0,11}|[1-9][0-9]{0,9})"
    number = lambda p: F.when(p.startswith("0x"), F.conv(F.substr(p, F.lit(3)), 16, 10)).when(p.startswith("0"), F.conv(p, 8, 10)).otherwise(p).cast("long")

    def whole(parts: Column) -> Column:
        count = F.size(parts)
        heads, last = F.slice(parts, 1, count - 1), F.get(parts, count - 1)
        room = F.get(F.array(*[F.lit(256 ** (4 - k)) for k in range(4)]), count - 1)
        value = F.aggregate(F.transform(heads, lambda x: x), F.lit(0).cast("long"), lambda a, x: a * 256 + x) * room + last
        return F.when(~F.exists(heads, lambda x: x > 255) & (last < room), value)

    return F.when(host.rlike(rf"^{part}(?:\.{part}){{0,3}}$"), bind(F.transform(F.split(host, r"\."), number), whole))


def ipv6(host: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, without its zone, null for anything else."""
    quad = r"^([0-9a-f:]*:)((?:[0-9]{1,3}\.){3}[0-9]{1,3})$"
    pair = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n % 65536)))
    dotted = lambda h: F.when(h.rlike(quad), F.concat(F.regexp_extract(h, quad, 1), bind(ipv4(F.regexp_extract(h, quad, 2)), pair))).otherwise(h)
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")

    def filled(h: Column) -> Column:
        short = h.contains("::")
        left = groups(F.substring_index(h, "::", 1))
        right = F.when(short, groups(F.substring_index(h, "::", -1))).otherwise(F.array().cast("array<string>"))
        return bind(F.struct(left.alias("l"), right.alias("r")), lambda s: told(h, short, s))

    def told(h: Column, short: Column, s: Column) -> Column:
        n = F.size(s["l"]) + F.size(s["r"])
        sound = h.rlike("^[0-9a-f:]+$") & ~h.rlike(":::|::.*::|[0-9a-f]{5}|^:[^:]|[^:]:$") & F.when(short, n <= 7).otherwise(n == 8)
        every = F.concat(s["l"], F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), s["r"])
        return F.when(sound, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return F.when(host.contains(":"), bind(dotted(F.regexp_replace(host, "%.*$", "")), filled))


def _inside(value: Column, ranges: tuple[str, ...], show: Callable[[int], int | str]) -> Column:
    nets = map(ipaddress.ip_network, ranges)
    return any_of([value.between(show(int(n.network_address)), show(int(n.broadcast_address))) for n in nets])


def _private_number(n: Column) -> Column:
    return _inside(n, PRIVATE_4, int) & ~_inside(n, PUBLIC_4, int)


def _private_digits(h: Column) -> Column:
    """IPv4 addresses inside IPv6 ones lie in reserved ranges, whatever they are."""
    digits = lambda n: f"{n:032x}"
    return _inside(h, PRIVATE_6, digits) & ~_inside(h, PUBLIC_6, digits)


def private_address(host: Column) -> Column:
    """Whether a host is an IPv4 or IPv6 address, in any form that a resolver takes, or a local name, that isn't public; other names aren't looked up."""
    local = (host == "localhost") | host.endswith(".localhost")
    return local | F.coalesce(bind(ipv4(host), _private_number), bind(ipv6(host), _private_digits), F.lit(False))


def fetch_refusal(url: Column) -> Column:
    """Why a URL may not be fetched, null if nothing but its name's address is left to check."""
    scheme, host = F.lower(F.regexp_extract(strip(url), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)), hostname(strip(url))
    return F.when(~scheme.isin("http", "https"), "unsupported_scheme").when(host == "", "missing_host").when(private_address(host), "private_network_blocked")
