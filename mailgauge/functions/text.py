"""Text cues, spam points, highlights, redaction: built-in column expressions only."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgauge.functions import lexicon as L

CUES = {"urgency": L.URGENCY, "threat": L.THREAT, "payment": L.PAYMENT, "credential": L.CREDENTIAL, "action": L.ACTION, "takeover": L.TAKEOVER}


def barrier(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with columns computed once: later expressions refer to them instead of repeating what makes them.

    Generating one row from a one-element array keeps Catalyst from merging the projections.
    """
    made = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select("*", F.inline(made))


def once(build: Callable) -> Callable:
    """``build``, whose expressions are made once for each of its arguments: thousands of calls to the JVM, whatever the data."""
    made: dict = {}

    @functools.wraps(build)
    def get(*key):
        key = (id(SparkContext._gateway), *key)
        if key not in made:
            if len(made) >= 32:
                made.clear()
            made[key] = build(*key[1:])
        return made[key]

    return get


def certain_words(pattern: str) -> str:
    """The longest plain text that every match of a pattern contains, empty if there is none."""
    bare = re.sub(r"\(\?:[^)]*\)\??|\[[^\]]*\][?*+]?|\\.[?*+]?|[^\\]\?", "\n", pattern)
    return max(re.split(r"[^a-z ]+", bare), key=len)


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern matches; a plain search for what its matches must contain comes first, as it is far cheaper."""
    word = certain_words(pattern)
    return (text.contains(word) & text.rlike(pattern)) if word else text.rlike(pattern)


def pattern_hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns match, each once."""
    return sum((matches(text, p).cast("int") for p in patterns), F.lit(0))


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words are substrings, each once."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def keywords_found(text: Column, words: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def any_keyword(text: Column, words: tuple[str, ...]) -> Column:
    return keyword_hits(text, words) > 0


#: Fixed value: what str.strip() takes for white space, but for rare Unicode blanks.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2003\u2028\u2029\u3000"


def strip(text: Column) -> Column:
    """``text`` without white space at its ends; Spark's trim() takes blanks only."""
    return F.btrim(text, F.lit(WHITE))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it; Spark shares nothing inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def bang_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))


def subject_points(subject: Column) -> Column:
    s = F.lower(strip(F.coalesce(subject, F.lit(""))))
    action = any_keyword(s, L.SUBJECT_ACTIONS)
    points = F.when(any_keyword(s, L.SUBJECT_ACCOUNTS) & action, 2).otherwise(0)
    for flag in (s.contains("action required"), any_keyword(s, L.SUBJECT_BRANDS) & action, s.contains("pending") & s.contains("message"), bang_count(s) >= 2):
        points = points + flag.cast("int")
    return points


def impersonation(lowered: Column) -> Column:
    """Roles that the text speaks of, each once, in order of the list."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(lowered.contains(n), F.lit(label)) for n, label in L.IMPERSONATION])))


def highlights(raw: Column, low: Column, most: int = 4) -> Column:
    """The first sentences or lines with a cue of urgency, threat or credentials, each cut to 180 characters."""
    cues = L.URGENCY + L.THREAT + L.CREDENTIAL
    pattern = "|".join(f"(?:{p})" for p in cues)
    blocks = F.transform(F.split(raw, r"(?<=[.!?])\s+|\n+"), strip)
    found = F.transform(F.slice(F.filter(blocks, lambda b: F.lower(b).rlike(pattern)), 1, most), lambda b: F.substring(b, 1, 180))
    # A text without a cue has no sentence with one; most texts aren't split at all.
    return F.when(pattern_hits(low, cues) > 0, found).otherwise(F.array().cast("array<string>"))


def cue_text(subject: Column, text: Column, body: Column) -> Column:
    """What cues are looked for in: subject, text and body, a line each."""
    return strip(F.concat_ws("\n", subject, text, body))


def nlp_cues(subject: Column, raw: Column, low: Column) -> list[Column]:
    """Shares of three hits capped at 1, keyword hits, impersonation and highlights; ``raw``: the cue text, ``low``: in lower case.

    Both should be columns computed before, as dozens of searches read them. Nulls count as empty.
    """
    raw, low = F.coalesce(raw, F.lit("")), F.coalesce(low, F.lit(""))
    share = lambda n: F.least(F.lit(1.0), n / F.lit(3.0))
    out = [share(pattern_hits(low, p)).alias(name) for name, p in CUES.items()]
    return [
        *out,
        share(subject_points(subject)).alias("subject_risk"),
        keyword_hits(low, L.KEYWORDS).alias("keyword_hits"),
        impersonation(low).alias("impersonation"),
        highlights(raw, low).alias("highlights"),
    ]


def spam_score(low: Column, url_count: Column) -> Column:
    """0 to 10 from the lower-case cue text and the number of URLs."""
    points = keyword_hits(low, L.PROMO) + pattern_hits(low, L.PROMO_PATTERNS) + (bang_count(low) >= 3).cast("int") + (url_count >= 2).cast("int")
    return F.least(F.lit(10), points)


def mask_email(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\b([a-z0-9._%+-]{1,2})[a-z0-9._%+-]{0,62}@([a-z0-9.-]+\.[a-z]{2,})\b", "$1***@$2")


def redact_text(text: Column) -> Column:
    """E-mail addresses masked, runs of 30 or more token characters replaced."""
    return F.regexp_replace(mask_email(text), r"\b[A-Za-z0-9_-]{30,}\b", "<redacted-token>")


def decoded(part: Column) -> Column:
    """A query's key or value as it was before encoding; as it stands where its percent signs don't decode."""
    spaced = F.replace(part, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(F.replace(spaced, F.lit(" "), F.lit("%20"))), spaced)


def encoded(part: Column) -> Column:
    """A key or value encoded for a query: a blank as plus, letters, digits and ``_.-~`` as they are."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def redact_url(url: Column) -> Column:
    """Decoded query values of secret keys, or of over 24 characters, by a short hash; no fragment."""
    base, query = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)

    def shown(key: Column, value: Column) -> Column:
        secret = F.lower(key).isin(*L.TOKEN_KEYS) | (F.length(value) > 24)
        digest = F.concat(F.lit("<redacted:"), F.substring(F.sha2(value, 256), 1, 12), F.lit(">"))
        return F.concat(encoded(key), F.lit("="), encoded(F.when(~secret, value).when(value == "", "<redacted>").otherwise(digest)))

    key = lambda p: decoded(F.regexp_extract(p, r"^([^=]*)", 1))
    value = lambda p: decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1))
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    pair = lambda p: bind(F.struct(key(p).alias("k"), value(p).alias("v")), lambda x: shown(x["k"], x["v"]))
    line = F.array_join(F.transform(parts, pair), "&")
    return mask_email(F.when(F.size(parts) == 0, base).otherwise(F.concat(base, F.lit("?"), line)))
