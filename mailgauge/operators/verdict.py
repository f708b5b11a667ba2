"""Paths, verdicts, labels, confidence and checks of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgauge.operators.score import Policy

#: Confidences from which a judge's verdict counts.
PROMOTE, OVERRIDE = 0.75, 0.58


def path_of(route: Column) -> Column:
    r = F.lower(F.trim(route))
    return F.when(r == "allow", "FAST").when(r == "deep", "DEEP").otherwise("STANDARD")


def verdict_of(score: Column, p: Policy = Policy()) -> Column:
    return F.when(score > p.suspicious_max, "phishing").when(score >= p.suspicious_min, "suspicious").otherwise("benign")


def clamp(score: Column, verdict: Column, p: Policy = Policy()) -> Column:
    """The score moved into its verdict's band."""
    top = F.greatest(F.lit(1), F.lit(p.suspicious_max) + 1)
    middle = F.greatest(F.lit(p.suspicious_min), F.least(F.lit(p.suspicious_max), score))
    return F.when(verdict == "phishing", F.greatest(top, score)).when(verdict == "suspicious", middle).otherwise(F.least(F.greatest(F.lit(0), F.lit(p.suspicious_min) - 1), score))


def merge_judge(score: Column, judge: Column, conf: Column, p: Policy = Policy()) -> Column:
    """The verdict of a score band and a judge's verdict with its confidence."""
    hi, lo = max(PROMOTE, OVERRIDE), min(PROMOTE, OVERRIDE)
    own = F.when(F.lower(F.trim(judge)).isin("benign", "suspicious", "phishing"), F.lower(F.trim(judge))).otherwise(verdict_of(score, p))
    below = score < p.suspicious_min
    return (
        F.when(score > p.suspicious_max, "phishing")
        .when(below & (own == "phishing"), F.when(conf >= hi, "phishing").when(conf >= lo, "suspicious").otherwise("benign"))
        .when(below & (own == "suspicious") & (conf >= OVERRIDE), "suspicious")
        .when(below & (score >= F.greatest(F.lit(1), F.lit(p.suspicious_min) - 10)) & (conf < OVERRIDE), "suspicious")
        .when(below, "benign")
        .otherwise(own)
    )


def _cents(x: Column) -> Column:
    return F.rint(x * 100) / 100


def confidence_of(score: Column, verdict: Column, judge: Column, missing: Column) -> Column:
    own = F.when(judge > 0, judge).otherwise(F.get(F.array(*[F.lit(round(0.35 + r / 100.0 * 0.55, 2)) for r in range(101)]), score))
    less = own - F.least(F.lit(0.2), missing * 0.05)
    less = F.when(verdict == "suspicious", F.least(less, F.lit(0.78))).otherwise(less)
    less = F.when((verdict == "benign") & (score >= 20), F.least(less, F.lit(0.62))).otherwise(less)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _cents(less)))


def labels(verdict: Column, score: Column, spam: Column) -> Column:
    """struct(email_label, is_spam, is_phish_email, threat_tags)."""
    phish = (verdict == "phishing") | (score >= 35)
    junk = phish | (spam >= 2)
    tags = F.array_compact(F.array(F.when(junk, F.lit("spam")), F.when(phish, F.lit("phish_email"))))
    return F.struct(F.when(phish, "phish_email").when(junk, "spam").otherwise("benign").alias("email_label"), junk.alias("is_spam"), phish.alias("is_phish_email"), tags.alias("threat_tags"))


def final_verdict(score: Column, p: Policy = Policy()) -> tuple[Column, Column]:
    """Verdict and score without a judge: suspicious counts as phishing, at a score of 35 at least."""
    own = verdict_of(score, p)
    doubtful = own == "suspicious"
    verdict = F.when(doubtful, "phishing").otherwise(own)
    return verdict, F.when(verdict == "phishing", F.greatest(F.lit(35), score)).otherwise(score)


def issues(verdict: Column, score: Column, indicators: Column, evidence: Column) -> Column:
    """Codes of what is wrong with a result, in order."""
    v, n = F.lower(F.trim(F.coalesce(verdict, F.lit("")))), score.try_cast("double").cast("int")
    phish = v == "phishing"
    tests = [
        ("invalid_verdict", ~v.isin("benign", "phishing", "suspicious")),
        ("invalid_risk_score_type", n.isNull()),
        ("invalid_risk_score_range", ~F.coalesce(n, F.lit(-1)).between(0, 100)),
        ("missing_indicators", phish & (F.coalesce(F.size(indicators), F.lit(0)) <= 0)),
        ("missing_evidence", phish & evidence.isNull()),
    ]
    return F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests]))


def sampled(key: Column, rate: float, salt: str = "") -> Column:
    """A salted-hash sample: the same rows at every run."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "|"), key), 256), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))
    return bucket < rate if rate > 0 else F.lit(False)


def invoke_judge(route: Column, has_content: Column, key: Column, mode: str = "never", rate: float = 0.0, salt: str = "", remote: bool = True) -> Column:
    allowed = F.lit(True) if mode == "always" else sampled(key, rate, salt) if mode == "sampled" else F.lit(False)
    return has_content & F.lit(remote) & ((F.lower(F.trim(route)) != "allow") | allowed)


def _path_like(name: Column) -> Column:
    return F.lower(name).startswith("file://") | name.isin(".", "..") | name.startswith("~") | name.rlike(r"[/\\]")


def input_error(raw: Column) -> Column:
    """The code for which a request's text is refused, null if it isn't: JSON that names a file to read, or attachments
    that aren't objects of a plain name. Text that isn't a JSON object is never refused here."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    v = F.when(t.startswith("{") & t.endswith("}"), F.try_parse_json(t))
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    string = lambda x, path: F.when(kind(F.try_variant_get(x, path, "variant")) == "STRING", F.try_variant_get(x, path, "string"))
    given = F.try_variant_get(v, "$.attachments", "variant")
    items = F.try_variant_get(v, "$.attachments", "array<variant>")

    def item_error(x: Column) -> Column:
        name = F.trim(F.coalesce(string(x, "$.name"), string(x, "$.filename"), F.lit("")))
        plain = kind(x).startswith("OBJECT") & (name != "")
        return F.when(~plain, "invalid_attachment_schema").when(_path_like(name), "unsafe_attachment_path")

    first = F.get(F.filter(F.transform(items, item_error), lambda x: x.isNotNull()), F.lit(0))
    listed = kind(given).startswith("ARRAY")
    path = F.coalesce(F.trim(string(v, "$.eml_path")), F.lit("")) != ""
    code = F.when(path, "unsupported_eml_path").when((kind(given) != "VOID") & ~listed, "invalid_attachment_schema").when(listed, first)
    return F.when(v.isNotNull() & kind(v).startswith("OBJECT"), code)


def judged(p: Policy = Policy()) -> list[Column]:
    """decided_by, final_verdict and final_score of columns raw_score, judge (null: none) and judge_confidence."""
    there, score = F.col("judge").isNotNull(), F.col("raw_score")
    merged = merge_judge(score, F.col("judge"), F.coalesce("judge_confidence", F.lit(0.0)), p)
    alone, alone_score = final_verdict(score, p)
    return [
        F.when(there, "judge").otherwise("deterministic").alias("decided_by"), F.when(there, merged).otherwise(alone).alias("final_verdict"),
        F.when(there, clamp(score, merged, p)).otherwise(alone_score).alias("final_score"),
    ]


def with_judges(triaged: DataFrame, verdicts: DataFrame, p: Policy = Policy()) -> DataFrame:
    """``triaged`` (email_id, raw_score, ...) plus judge, judge_confidence, decided_by, final_verdict, final_score.

    Of several verdicts (email_id, judged_at, judge, judge_confidence) on a message the first counts, found with map-side
    combine; messages without one have the deterministic verdict. Verdicts without a judge's word or an id are left out.
    """
    first = verdicts.where("judge is not null and email_id is not null").groupBy("email_id").agg(F.min(F.struct("judged_at", "judge", "judge_confidence")).alias("v"))
    both = triaged.join(first.select("email_id", "v.judge", "v.judge_confidence"), "email_id", "left")
    return both.select(*triaged.columns, "judge", "judge_confidence", *judged(p))
