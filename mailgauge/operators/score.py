"""Risk scores over signal arrays: no shuffle, one row a message in and out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgauge.functions import lexicon as L
from mailgauge.functions.text import any_keyword


@dataclass(frozen=True)
class Policy:
    """Weights and thresholds, which become literals of the plan."""

    review: int = 30
    deep: int = 70
    url_weight: int = 24
    high_domain: int = 35
    path_bonus: int = 8
    path_cap: int = 24
    brand_divisor: int = 2
    brand_cap: int = 20
    keyword_weight: int = 9
    urgency_weight: int = 8
    action_weight: int = 8
    core_bonus: int = 15
    finance_bonus: int = 12
    finance_pressure: int = 12
    urgency_pressure: int = 8
    suspicious_min: int = 30
    suspicious_max: int = 34
    context_trigger: int = 35

    def but(self, **changes) -> Policy:
        return replace(self, **changes)


URL_POINTS = {"shortlink": 12, "brand-spoof": 16, "login-intent": 14, "punycode": 10, "suspicious-pattern": 8, "domain-high-risk": 10}
WEB_POINTS = {"credential-harvest": 18, "brand-impersonation": 12, "otp-collection": 8}
ATTACHMENT_POINTS = {"macro-suspected": 18, "extension-mismatch": 16, "executable-like": 14}
URL_REASONS = (("brand-spoof", "url:brand_spoof"), ("login-intent", "url:login_intent"), ("domain-high-risk", "url:domain_high_risk"))


def total(items: Column, points: Callable[[Column], Column]) -> Column:
    """Sum of integer points over an array; 0 for an empty or null one."""
    return F.coalesce(F.aggregate(F.transform(items, points), F.lit(0), lambda s, x: s + x), F.lit(0))


def flag_points(points: dict[str, int]) -> Callable[[Column], Column]:
    return lambda x: sum((F.when(F.array_contains(x["risk_flags"], f), n).otherwise(0) for f, n in points.items()), F.lit(0))


def has_flag(items: Column, flag: str) -> Column:
    return F.coalesce(F.exists(items, lambda x: F.array_contains(x["risk_flags"], flag)), F.lit(False))


def reason_list(tests: list[tuple[Column, str]], most: int = 12) -> Column:
    return F.slice(F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in tests])), 1, most)


def header_points(h: Column) -> tuple[Column, list[tuple[Column, str]]]:
    received = F.size(h["received_patterns"])
    tests = [
        (h["spf"].isin("fail", "softfail"), 16, "header:spf_fail"),
        (h["dkim"] == "fail", 10, "header:dkim_weak"),
        (h["dmarc"] == "fail", 16, "header:dmarc_weak"),
        (h["mismatch"], 12, "header:from_replyto_mismatch"),
        (received > 0, F.least(F.lit(18), received * 6), "header:received_chain_anomaly"),
    ]
    return sum((F.when(t, n).otherwise(0) for t, n, _ in tests), F.lit(0)), [(t, r) for t, _, r in tests]


def url_points(urls: Column, p: Policy) -> tuple[Column, list[tuple[Column, str]]]:
    """Points of all URLs, with the brand context's outside their cap, and the reasons: those of one URL before the next one's."""
    each = flag_points(URL_POINTS)
    own = total(urls, lambda s: each(s) + F.when(F.size(s["risk_flags"]) > 0, p.url_weight).otherwise(0) + F.when(s["domain_risk"] >= p.high_domain, 8).otherwise(0))
    path = F.least(F.lit(p.path_cap), total(urls, lambda s: F.when(s["has_login_keywords"], p.path_bonus).otherwise(0)))
    brand = F.least(F.lit(p.brand_cap), total(urls, lambda s: F.when(s["brand"] != "", (s["similarity"] * 100 / p.brand_divisor).cast("int")).otherwise(0)))
    return F.least(F.lit(60), own + path) + brand, [(path > 0, "url:path_login_pattern"), (brand > 0, "url:brand_context")]


def text_points(c: Column, p: Policy) -> tuple[Column, list[tuple[Column, str]]]:
    on = {k: c[k] > 0 for k in ("urgency", "threat", "payment", "credential", "action", "takeover", "subject_risk", "keyword_hits")}
    base = (
        c["urgency"] * (F.lit(p.urgency_weight) + 6).cast("double") + c["threat"] * 16.0 + c["payment"] * 9.0 + c["credential"] * 18.0
        + c["action"] * (F.lit(p.action_weight) + 2).cast("double") + c["takeover"] * 20.0 + c["subject_risk"] * 18.0
    ).cast("int")
    asks, press = on["credential"] | on["action"], on["threat"] | on["urgency"]
    tests = [
        (on["keyword_hits"], F.least(F.lit(24), c["keyword_hits"] * F.greatest(F.lit(1), F.floor(F.lit(p.keyword_weight) / 2).cast("int"))), "text:phishing_keyword_cluster"),
        (on["credential"] & press, F.least(F.lit(20), F.greatest(F.lit(0), F.lit(p.core_bonus) - 5)), "text:credential_pressure"),
        (on["payment"] & asks, F.lit(p.finance_bonus), "text:finance_action_combo"),
        (on["payment"] & press, F.lit(p.finance_pressure), "text:finance_pressure"),
        (on["urgency"] & asks, F.lit(p.urgency_pressure), "text:urgency_pressure"),
        (on["takeover"] & asks, F.lit(8), "text:account_takeover_pattern"),
        ((F.size(c["impersonation"]) > 0) & (on["credential"] | on["takeover"]), F.lit(6), "text:impersonation_pressure"),
        (on["subject_risk"] & (on["credential"] | on["takeover"] | (c["keyword_hits"] >= 2)), F.lit(8), "text:subject_attack_pattern"),
        (any_keyword(F.lower(F.array_join(c["highlights"], " ")), L.PHISHING_WORDS), F.lit(8), "text:phishing_keywords"),
    ]
    return F.least(F.lit(55), base + sum((F.when(t, n).otherwise(0) for t, n, _ in tests), F.lit(0))), [(t, r) for t, _, r in tests]


def route_of(score: Column, p: Policy) -> Column:
    return F.when(score <= p.review, "allow").when(score <= p.deep, "review").otherwise("deep")


def pre_score(header: Column, urls: Column, web: Column, attachments: Column, cues: Column, p: Policy = Policy()) -> Column:
    """struct(risk_score, route, reasons) of the signals of a message."""
    head, head_why = header_points(header)
    link, link_why = url_points(urls, p)
    text, text_why = text_points(cues, p)
    site = F.least(F.lit(35), total(web, flag_points(WEB_POINTS)))
    file = F.least(F.lit(35), total(attachments, flag_points(ATTACHMENT_POINTS)))
    score = F.greatest(F.lit(0), F.least(F.lit(100), head + link + site + file + text))
    flagged = F.flatten(F.transform(urls, lambda s: F.array_compact(F.array(*[F.when(F.array_contains(s["risk_flags"], f), F.lit(r)) for f, r in URL_REASONS]))))
    files = F.flatten(F.transform(attachments, lambda s: F.array_compact(F.array(*[F.when(F.array_contains(s["risk_flags"], f), F.lit(r)) for f, r in (("macro-suspected", "attachment:macro_suspected"), ("extension-mismatch", "attachment:extension_mismatch"))]))))
    none = F.array().cast("array<string>")
    reasons = F.concat(reason_list(head_why), F.coalesce(flagged, none), reason_list([*link_why, (has_flag(web, "credential-harvest"), "web:credential_harvest")]), F.coalesce(files, none), reason_list(text_why))
    return F.struct(score.alias("risk_score"), route_of(score, p).alias("route"), F.slice(F.array_distinct(reasons), 1, 12).alias("reasons"))


def component_scores(cues: Column, urls: Column, attachments: Column, image_risks: Column | None = None) -> Column:
    """struct(text, url, domain, attachment, ocr), each 0 to 100: the largest of a kind, the mean of four text cues."""
    largest = lambda xs: F.coalesce(F.array_max(xs), F.lit(0))
    flags = lambda xs, n: largest(F.transform(xs, lambda s: F.least(F.lit(100), F.size(s["risk_flags"]) * n)))
    text = ((cues["urgency"] + cues["threat"] + cues["payment"] + cues["credential"]) / 4 * 100).cast("int")
    return F.struct(text.alias("text"), flags(urls, 14).alias("url"), largest(F.transform(urls, lambda s: s["domain_risk"])).alias("domain"), flags(attachments, 15).alias("attachment"), (largest(image_risks) if image_risks is not None else F.lit(0)).alias("ocr"))


#: Weights of the fused score.
FUSION = {"text": 0.22, "url": 0.24, "domain": 0.18, "attachment": 0.26, "ocr": 0.10}


def fuse(components: Column, weights: dict[str, float] | None = None) -> Column:
    """struct(risk_score, risk_level, verdict): the weighted mean, rounded half to even."""
    w = weights if weights and sum(weights.values()) > 0 else FUSION
    all_of = sum(w[k] for k in FUSION)
    bounded = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(x.try_cast("double").cast("int"), F.lit(0))))
    score = F.rint(sum((bounded(components[k]) * (w[k] / all_of) for k in FUSION), F.lit(0.0))).cast("int")
    return F.struct(score.alias("risk_score"), F.when(score >= 70, "high").when(score >= 35, "medium").otherwise("low").alias("risk_level"), F.when(score >= 35, "phishing").otherwise("benign").alias("verdict"))


def context_gate(kind: str, items: Column, score: Column, flags: tuple[str, ...], p: Policy = Policy()) -> Column:
    """struct(collect, reason): whether a message's URLs or attachments deserve a closer look."""
    hit = F.filter(F.transform(items, lambda s: F.array_min(F.array_intersect(s["risk_flags"], F.array(*map(F.lit, sorted(flags)))))), lambda x: x.isNotNull())
    first = F.get(hit, F.lit(0))
    n = F.coalesce(F.size(items), F.lit(0))
    reason = F.when(n <= 0, f"no_{kind}_signals").when(score >= p.context_trigger, "risk_score_threshold").when(first.isNotNull(), F.concat(F.lit(f"{kind}_flag:"), first)).otherwise("no_web_trigger" if kind == "url" else "no_attachment_trigger")
    return F.struct(((n > 0) & ((score >= p.context_trigger) | first.isNotNull())).alias("collect"), reason.alias("reason"))


def admission(name: str, gate: Column, collected: Column, candidates: Column, enabled: bool | None) -> Column:
    """struct(status, reason) of a kind of context."""
    blocked = gate["collect"] if enabled is False else F.lit(False)
    status = F.when(collected, "admitted").when(blocked, "skipped_by_policy").when(candidates <= 0, "skipped_by_signal").otherwise("skipped_by_score")
    reason = F.when(collected, gate["reason"]).when(blocked, f"{name}_policy_disabled").when(candidates <= 0, f"no_{name}_candidates").otherwise(gate["reason"])
    return F.struct(status.alias("status"), reason.alias("reason"))


def chain_flags(urls: Column, attachments: Column, html: Column) -> Column:
    some = lambda xs: F.coalesce(F.size(xs), F.lit(0)) > 0
    tests = [("contains_url", some(urls)), ("contains_attachment", some(attachments)), ("html_active_content", F.coalesce(html, F.lit("")).rlike("(?i)<form|<iframe")), ("url_to_attachment_chain", some(urls) & some(attachments))]
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))


def heuristic_path(text: Column, suspicious: Column, url_count: Column, attachments: Column, risky: Column, hidden: Column, chain: Column) -> Column:
    """FAST, STANDARD or DEEP by a score of its own with overrides."""
    from mailgauge.functions.text import keyword_hits, pattern_hits

    low, cap = F.lower(F.coalesce(text, F.lit(""))), lambda n, x: F.least(F.lit(n), x)
    has = lambda f: F.array_contains(chain, f)
    links = sum((has(f).cast("int") for f in ("url_to_attachment_chain", "nested_url_in_attachment", "hidden_html_links", "contains_attachment")), F.lit(0))
    score = cap(4, keyword_hits(low, L.ROUTER_TOKENS)) + cap(3, keyword_hits(low, L.ROUTER_URGENCY)) + cap(3, pattern_hits(low, L.ROUTER_ACTIONS)) + cap(4, suspicious * 2) + F.when(url_count >= 3, 2).otherwise(0)
    score = score + F.when(hidden > 0, 2).otherwise(0) + cap(3, links) + (attachments > 0).cast("int") + cap(3, risky * 2)
    attack = has("url_to_attachment_chain") | has("nested_url_in_attachment") | (has("contains_url") & has("contains_attachment"))
    deep = (risky > 0) | ((hidden > 0) & (suspicious > 0)) | (suspicious >= 2) | (attack & (suspicious > 0)) | (score >= 8)
    return F.when(deep, "DEEP").when((score >= 3) | (suspicious > 0) | (attachments > 0) | (url_count >= 2), "STANDARD").otherwise("FAST")
