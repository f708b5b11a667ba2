"""What a judge is shown of a message: the most telling items within its path's budget, and numbered references to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgauge.functions import text as T
from mailgauge.functions import url as U
from mailgauge.operators import evidence as E
from mailgauge.plans.triage import barrier

#: Section, category and source of references, in the order that numbers them; lists come after.
SECTIONS = (("email_context", "email", "email"), ("pre_score", "pre_score", "pre_score"), ("precheck_summary", "precheck", "precheck"), ("header_summary", "header", "header"), ("nlp_summary", "nlp", "nlp"))
LISTS = (
    ("selected_url_signals", "url_signal", "url"), ("selected_attachment_signals", "attachment_signal", "attachment_signal"), ("selected_domain_reports", "domain_report", "domain"),
    ("selected_web_signals", "web_signal", "web"), ("selected_attachment_reports", "attachment_report", "attachment_report"), ("selected_url_target_reports", "url_target_report", "url_target"),
)
MOST_REFS = 64
REFS = "array<struct<evidence_path:string,category:string,source:string,key:string>>"


def clean(values: Column, most: int | Column) -> Column:
    """Trimmed, without blanks and repeats, at most ``most``."""
    kept = F.array_distinct(F.filter(F.transform(values, T.strip), lambda x: x != ""))
    return F.slice(kept, F.lit(1), F.lit(most) if isinstance(most, int) else most)


def top_reports(items: Column, path: Column, kind: str, marks: str = "indicators") -> Column:
    """The reports that the path shows: most risk first, then most marks, then input order."""
    ranked = F.transform(items, lambda x, i: F.struct((-x["risk_score"]).alias("a"), (-F.size(x[marks])).alias("b"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(ranked), F.lit(1), E.budget(path, kind)), lambda r: r["x"])


def domain_reports(url_signals: Column) -> Column:
    """A report of each host of the signals, once."""
    hosts = F.filter(F.array_distinct(F.transform(url_signals, lambda s: s["final_domain"])), lambda h: h != "")
    each = lambda h: F.struct(h.alias("domain"), U.base_domain(h).alias("base_domain"), U.domain_risk(h).alias("risk_score"), U.domain_indicators(h).alias("indicators"), U.typosquat_brands(h).alias("typosquat_brands"), U.suspicious_tokens(h).alias("suspicious_tokens"))
    return F.transform(hosts, each)


def _url(s: Column) -> Column:
    brand = F.when(s["brand"] != "", F.struct(s["brand"].alias("brand"), s["similarity"].alias("similarity")))
    return F.struct(s["url"].alias("url"), s["final_domain"].alias("final_domain"), s["is_shortlink"].alias("is_shortlink"), s["has_login_keywords"].alias("has_login_keywords"), s["domain_risk"].alias("domain_risk_score"), clean(s["risk_flags"], 6).alias("risk_flags"), s["confidence"].alias("confidence"), brand.alias("looks_like_brand"))


def _domain(r: Column) -> Column:
    return F.struct(r["domain"].alias("domain"), r["base_domain"].alias("base_domain"), r["risk_score"].alias("risk_score"), clean(r["indicators"], 5).alias("indicators"), clean(r["typosquat_brands"], 3).alias("typosquat_brands"), clean(r["suspicious_tokens"], 4).alias("suspicious_tokens"))


def _file(s: Column) -> Column:
    return F.struct(*[s[c].alias(c) for c in ("filename", "mime", "is_archive", "is_executable_like", "macro_suspected", "confidence")], clean(s["risk_flags"], 6).alias("risk_flags"))


def _report(r: Column) -> Column:
    return F.struct(r["name"].alias("name"), r["type"].alias("type"), r["risk_score"].alias("risk_score"), clean(r["indicators"], 6).alias("indicators"), F.size(clean(r["extracted_urls"], 8)).alias("extracted_urls_count"))


def _web(s: Column) -> Column:
    return F.struct(s["risk"].alias("risk"), clean(s["risk_flags"], 5).alias("risk_flags"), s["confidence"].alias("confidence"))


def judge_context(triaged: DataFrame) -> DataFrame:
    """The context of each triaged message, without a shuffle; sections that its path doesn't show are null.

    Of the optional columns ``web_signals``, ``attachment_reports`` and ``limits_hit`` (arrays) those present are shown.
    """
    has, path = set(triaged.columns), F.col("path")
    standard, deep, none = path.isin("STANDARD", "DEEP"), path == "DEEP", F.array().cast("array<string>")
    limits = clean(F.col("limits_hit"), 8) if "limits_hit" in has else none
    t = barrier(triaged, domains=domain_reports(F.col("url_signals")))
    status = lambda k: F.struct((F.col(f"{k}_admission.status") == "admitted").alias("collected"), F.col(f"{k}_admission.reason").alias("reason"), F.col(f"{k}_admission.status").alias("status"))
    odd = F.transform(F.filter("url_signals", lambda s: F.size(s["risk_flags"]) > 0), lambda s: s["url"])
    sections = {
        "email_context": F.struct(*[T.strip(F.col(c)).alias(c) for c in ("sender", "subject", "reply_to")], F.size("urls").alias("urls_count"), F.size("files").alias("attachments_count")),
        "pre_score": F.struct(F.col("raw_score").alias("risk_score"), "route", F.slice("indicators", 1, 12).alias("reasons")),
        "precheck_summary": F.struct(F.col("raw_score").alias("heuristic_score"), clean(F.col("indicators"), 8).alias("indicators"), clean(odd, 6).alias("suspicious_urls"), F.size("urls").alias("combined_url_count"), F.col("components").alias("component_scores"), limits.alias("limits_hit"), status("web").alias("web"), status("attachment").alias("attachment")),
        "header_summary": F.struct("header.spf", "header.dkim", "header.dmarc", F.col("header.mismatch").alias("from_replyto_mismatch"), F.col("header.hops").alias("received_hops"), clean(F.col("header.received_patterns"), 4).alias("received_anomalies"), "header.confidence"),
        "nlp_summary": F.struct(*[f"cues.{c}" for c in ("urgency", "threat", "payment", "credential", "action", "takeover", "subject_risk", "keyword_hits")], clean(F.col("cues.impersonation"), 3).alias("impersonation"), clean(F.col("cues.highlights"), E.budget(path, "highlights")).alias("highlights")),
        "selected_url_signals": F.transform(E.top_signals(F.col("url_signals"), path, "url_signals"), _url),
        "selected_attachment_signals": F.transform(E.top_signals(F.col("files"), path, "attachment_signals"), _file),
        "selected_domain_reports": F.transform(top_reports(F.col("domains"), path, "domain_reports"), _domain),
    }
    if "web_signals" in has:
        sections["selected_web_signals"] = F.when(standard, F.transform(E.top_signals(F.col("web_signals"), path, "web_signals"), _web))
    if "attachment_reports" in has:
        sections["selected_attachment_reports"] = F.when(deep, F.transform(top_reports(F.col("attachment_reports"), path, "attachment_reports"), _report))
    budget = F.struct(path.alias("path"), *[E.budget(path, k).alias(f"selected_{k}") for k in ("url_signals", "attachment_signals", "domain_reports", "web_signals", "attachment_reports")])
    return t.select("email_id", "path", "route", budget.alias("context_budget"), *[c.alias(n) for n, c in sections.items()])


def _ref(path: Column, category: str, source: str, payload: Column, tags: Column) -> Column:
    key = E.fingerprint(F.lit(category), F.to_json(payload), F.lit(source), tags)
    return F.struct(path.alias("evidence_path"), F.lit(category).alias("category"), F.lit(f"judge_context:{source}").alias("source"), key.alias("key"))


def _item_refs(name: str, category: str, source: str) -> Column:
    tags = F.array(F.lit(name), F.col("path"))
    return F.transform(name, lambda x, i: _ref(F.concat(F.lit(name + "["), i.cast("string"), F.lit("]")), category, source, x, tags))


def with_refs(context: DataFrame) -> DataFrame:
    """``context`` plus ``evidence_refs``: (evidence_id, evidence_path, category, source) of each section and item.

    Sections and items themselves get the fields evidence_id and evidence_path too.

    Equal evidence has one number, given at its first sight; at most MOST_REFS numbers are listed. All
    happens inside the message's row.
    """
    found = [F.array(*[_ref(F.lit(k), cat, src, F.col(k), F.array(F.lit(k))) for k, cat, src in SECTIONS])]
    for k, cat, src in LISTS:
        if k in context.columns:
            found.append(F.coalesce(_item_refs(k, cat, src), F.array().cast(REFS)))
    out = barrier(context, __refs=F.concat(*found))
    out = barrier(out, __keys=F.array_distinct(F.transform("__refs", lambda r: r["key"])))
    named = lambda r: F.struct(F.format_string("evd_%04d", F.array_position(F.col("__keys"), r["key"])).alias("evidence_id"), r["evidence_path"].alias("evidence_path"), r["category"].alias("category"), r["source"].alias("source"))
    shown = F.filter(F.transform("__refs", named), lambda r: F.substring(r["evidence_id"], 5, 12).cast("int") <= MOST_REFS)
    out = barrier(out, evidence_refs=shown, __ids=F.map_from_entries(F.array_distinct(F.transform("__refs", lambda r: F.struct(r["evidence_path"], named(r)["evidence_id"])))))
    marked = lambda x, at: x.withField("evidence_id", F.col("__ids")[at]).withField("evidence_path", at)
    items = lambda k: F.transform(k, lambda x, i: marked(x, F.concat(F.lit(k + "["), i.cast("string"), F.lit("]"))))
    own = {k: marked(F.col(k), F.lit(k)) for k, *_ in SECTIONS} | {k: items(k) for k, *_ in LISTS if k in context.columns}
    return out.withColumns(own).drop("__refs", "__keys", "__ids")


def current_path(path: Column) -> Column:
    """A path with the old name of a list replaced by the one in use."""
    olds = [k.removeprefix("selected_") for k, *_ in LISTS]
    return F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), rf"^({'|'.join(olds)})(?=$|[\[.])", "selected_$1")
