"""The triage of messages: signals, gated context, two-pass score, verdict, label; one plan, no shuffle but for context tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgauge.functions import attachment as A
from mailgauge.functions import decode as D
from mailgauge.functions import header as H
from mailgauge.functions import html as W
from mailgauge.functions import text as T
from mailgauge.functions import url as U
from mailgauge.functions.text import barrier
from mailgauge.operators import score as S
from mailgauge.operators import verdict as V

NO_SIGNALS = "array<struct<risk_flags:array<string>>>"
#: Fixed value: nested URLs of a message that its record shows.
MOST_NESTED = 20
#: The headers that hold results of authentication.
AUTH_HEADERS = ("authentication-results", "received-spf", "arc-authentication-results")


def _has(df: DataFrame, name: str, otherwise: Column) -> Column:
    return F.col(name) if name in df.columns else otherwise


def _names(many: bool) -> Column:
    """The attachments' names without white space around them, empty ones left out; ``many``: there is a column of several."""
    return F.filter(F.transform(F.col("names") if many else F.array("attachment"), T.strip), lambda x: x != "")


#: Columns of a message that count as empty where they are null.
TEXTS = ("subject", "text", "sender", "reply_to", "auth", "received", "attachment", "body", "html")


def filled(mail: DataFrame) -> DataFrame:
    return mail.withColumns({c: F.coalesce(c, F.lit("")) for c in TEXTS if c in mail.columns})


@T.once
def url_signals(p: S.Policy) -> Column:
    return F.transform(F.col("urls"), lambda u: T.bind(D.obfuscation(u), lambda hidden: U.url_signal(u, p.high_domain, hidden)))


def with_url_signals(df: DataFrame, p: S.Policy) -> DataFrame:
    """``df`` plus url_signals, a signal of each of ``urls`` with what its query hides."""
    return barrier(df, url_signals=url_signals(p))


@T.once
def _of_text(many: bool) -> dict[str, Column]:
    return {
        "cues": F.struct(*T.nlp_cues(F.col("subject"), F.col("raw"), F.col("low"))),
        "header": H.header_signals(F.col("auth"), F.col("received"), F.col("sender"), F.col("reply_to")),
        "files": F.transform(_names(many), A.signal),
    }


@T.once
def _score(p: S.Policy, web: bool) -> Column:
    """The score of a message; ``web``: with the signals of pages that the gate asks for, where there are any."""
    seen = F.when(F.col("url_gate.collect"), F.col("web_signals")) if web else F.array().cast(NO_SIGNALS)
    score = S.pre_score(F.col("header"), F.col("url_signals"), seen, F.col("files"), F.col("cues"), p)
    return F.when(F.size(seen) > 0, score).otherwise(F.col("first")) if web else score


@T.once
def _gates(p: S.Policy) -> dict[str, Column]:
    return {
        "url_gate": S.context_gate("url", F.col("url_signals"), F.col("first.risk_score"), ("shortlink", "brand-spoof", "login-intent"), p),
        "file_gate": S.context_gate("attachment", F.col("files"), F.col("first.risk_score"), ("macro-suspected", "extension-mismatch", "executable-like"), p),
    }


@T.once
def _outcome(p: S.Policy, urls: str, many: bool, html: bool, hidden: bool) -> dict[str, Column]:
    chain = S.chain_flags(F.col(urls), _names(many), F.col("html") if html else F.lit(""))
    if hidden:
        chain = F.concat(chain, F.array_compact(F.array(F.when(F.size("hidden_links") > 0, F.lit("hidden_html_links")))))
    verdict, final = V.final_verdict(F.col("scored.risk_score"), p)
    return {
        "risk_score": final, "route": F.col("scored.route"), "path": V.path_of(F.col("scored.route")), "verdict": verdict,
        "spam_score": T.spam_score(F.col("low"), F.size("urls")), "indicators": F.array_distinct(F.concat("scored.reasons", chain)),
    }


@T.once
def _record(fetch: bool) -> list[Column | str]:
    nested, n_urls, n_files = U.nested_urls(F.col("url_signals")), F.size("url_signals"), F.size("files")
    return [
        "email_id", "risk_score", F.col("scored.risk_score").alias("raw_score"), "route", "path", "verdict", "spam_score", "indicators",
        V.confidence_of(F.col("risk_score"), F.col("verdict"), F.lit(0.0), F.lit(0)).alias("confidence"),
        V.labels(F.col("verdict"), F.col("risk_score"), F.col("spam_score")).alias("labels"),
        S.component_scores(F.col("cues"), F.col("url_signals"), F.col("files")).alias("components"),
        S.admission("web", F.col("url_gate"), F.col("url_gate.collect") & F.lit(fetch), n_urls, fetch).alias("web_admission"),
        S.admission("attachment", F.col("file_gate"), F.col("file_gate.collect"), n_files, None).alias("attachment_admission"),
        F.slice(nested, 1, MOST_NESTED).alias("nested_urls"), limits_hit(F.col("url_signals"), nested).alias("limits_hit"),
        "urls", "url_signals", "files", "header", "cues", "subject", "sender", "reply_to",
    ]


def signals(mail: DataFrame, p: S.Policy = S.Policy()) -> DataFrame:
    """``mail`` (email_id, subject, text, sender, reply_to, auth, received, attachment) plus urls, cues, header, url_signals, files.

    Optional columns of ``mail``: body (text of the body), known_urls (found before, they come first), html_urls (they
    come last), names (of attachments, instead of attachment). Nulls count as empty. The queries of URLs are
    decoded; what they hide gives flags, nested URLs and limits that were met.
    """
    mail, none = filled(mail), F.array().cast("array<string>")
    body = _has(mail, "body", F.lit(""))
    urls = U.extract_urls(F.col("text"))
    if {"known_urls", "body", "html_urls"} & set(mail.columns):
        urls = F.array_distinct(F.concat(_has(mail, "known_urls", none), urls, U.extract_urls(body), _has(mail, "html_urls", none)))
    out = barrier(mail, urls=urls, raw=T.cue_text(F.col("subject"), F.col("text"), body))
    out = barrier(out, low=F.lower("raw"))
    return barrier(out, url_signals=url_signals(p), **_of_text("names" in mail.columns))


def limits_hit(signals: Column, nested: Column, most: int = MOST_NESTED) -> Column:
    """Names of the bounds that decoding the queries of a message's URLs has met."""
    some = lambda flag: F.exists(signals, lambda s: F.array_contains(s["query_flags"], flag))
    tests = [("url_query_param_cap_hit", some("query_param_cap_hit")), ("url_query_nested_url_cap_hit", some("nested_url_cap_hit")), ("query_nested_url_cap_hit", F.size(nested) > most)]
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))


def triage(mail: DataFrame, web: DataFrame | None = None, p: S.Policy = S.Policy(), fetch: bool = False) -> DataFrame:
    """The record of each message: score, route, path, verdict, labels, confidence, reasons and what context was admitted.

    ``web``, if given and ``fetch`` is on, holds (email_id, web_signals) of fetched pages, which count where the
    first score's gate asks for them. ``mail`` may have the optional columns of ``signals``, html (a body) and
    hidden_links. nested_urls and limits_hit tell what the queries of URLs hide.
    """
    out = barrier(signals(mail, p), first=_score(p, False))
    out = barrier(out, **_gates(p))
    if web is not None and fetch:
        out = barrier(out.join(web, "email_id", "left"), scored=_score(p, True))
    else:
        out = out.withColumn("scored", F.col("first"))
    there = set(mail.columns)
    out = barrier(out, **_outcome(p, "known_urls" if "known_urls" in there else "urls", "names" in there, "html" in there, "hidden_links" in there))
    return out.select(*_record(fetch))


def of_messages(parsed: DataFrame) -> DataFrame:
    """The columns that ``signals`` and ``triage`` take, from ``email_id`` and the columns of ``parse_messages``."""
    page = parsed.withColumn("__page", W.features_column(F.col("body_html")))
    return page.select(
        "email_id", "subject", "text", "sender", "reply_to",
        F.concat_ws(" ", *[F.coalesce(F.col("headers")[k], F.lit("")) for k in AUTH_HEADERS]).alias("auth"),
        F.col("headers_raw").alias("received"), F.lit("").alias("attachment"), F.col("body_text").alias("body"),
        F.col("urls").alias("known_urls"), F.col("__page.urls").alias("html_urls"), F.col("__page.hidden_links").alias("hidden_links"),
        F.col("attachments").alias("names"), F.col("body_html").alias("html"),
    )


def emergency(triaged: DataFrame, failed: Column) -> DataFrame:
    """``triaged`` with fixed values in the rows of messages that ``failed``: a score that sends them to review."""
    labels = F.struct(F.lit("phish_email").alias("email_label"), F.lit(False).alias("is_spam"), F.lit(True).alias("is_phish_email"), F.array(F.lit("fallback-error")).alias("threat_tags"))
    # Fixed values of the record of a message that couldn't be judged.
    fixed = {
        "risk_score": F.lit(35), "raw_score": F.lit(35), "route": F.lit("review"), "path": F.lit("STANDARD"), "verdict": F.lit("phishing"),
        "spam_score": F.lit(8), "confidence": F.lit(0.35), "indicators": F.array(F.lit("runtime:fallback_emergency")), "labels": labels,
    }
    return triaged.withColumns({n: F.when(failed, v.cast(triaged.schema[n].dataType)).otherwise(F.col(n)) for n, v in fixed.items()})


def triage_messages(parsed: DataFrame, p: S.Policy = S.Policy()) -> DataFrame:
    """The triage of messages as ``parse_messages`` gives them, a row each; those with a parse_error get the emergency record."""
    keyed = parsed.withColumn("email_id", F.struct("email_id", F.col("parse_error").isNotNull().alias("failed")))
    out = emergency(triage(of_messages(keyed), p=p), F.col("email_id.failed"))
    return out.withColumn("email_id", F.col("email_id.email_id"))


def summary(triaged: DataFrame) -> DataFrame:
    """Messages and mean score by path and verdict; combines before its shuffle of a row a group."""
    return triaged.groupBy("path", "verdict").agg(F.count("*").alias("messages"), (F.sum("risk_score") / F.count("*")).alias("mean_risk"))


def pages_of(signals: DataFrame, pages: DataFrame, most: int = 6) -> DataFrame:
    """(email_id, pos, url, page) for the first ``most`` URL signals of each message: the page fetched from it, or null.

    ``pages`` has a row a URL (url, page); its features are computed there, once a page and not once a message.
    """
    first = signals.select("email_id", F.posexplode(F.slice("url_signals", 1, most)).alias("pos", "s")).select("email_id", "pos", "s.url")
    return first.join(pages, "url", "left")
