"""Evidence per message: top-k, numbering, duplicates; and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgauge.functions import lexicon as L
from mailgauge.functions.attachment import extension_mismatch
from mailgauge.functions.text import strip
from mailgauge.functions.url import confidence


def budget(path: Column, kind: str) -> Column:
    out = F.lit(0)
    for name, most in L.BUDGETS.items():
        out = F.when(path == name, most.get(kind, 0)).otherwise(out)
    return out


def top_signals(items: Column, path: Column, kind: str) -> Column:
    """The most telling signals that the path shows: flagged first, more flags, more confidence, then input order; in place."""
    ranked = F.transform(items, lambda x, i: F.struct((-(F.size(x["risk_flags"]) > 0).cast("int")).alias("a"), (-F.size(x["risk_flags"])).alias("b"), (-x["confidence"]).alias("c"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(ranked), F.lit(1), budget(path, kind)), lambda r: r["x"])


def fingerprint(category: Column, payload: Column, source: Column, tags: Column) -> Column:
    """Equal for equal evidence whatever the order of its tags."""
    return F.sha2(F.to_json(F.struct(category.alias("c"), payload.alias("p"), source.alias("s"), F.array_sort(tags).alias("t"))), 256)


def number_evidence(evidence: DataFrame) -> DataFrame:
    """(email_id, seq, fingerprint, ...) without repeats, each with ``evidence_id`` in order of first sight in its message."""
    first = evidence.withColumn("__n", F.row_number().over(Window.partitionBy("email_id", "fingerprint").orderBy("seq"))).where("__n = 1").drop("__n")
    return first.withColumn("evidence_id", F.format_string("evd_%04d", F.row_number().over(Window.partitionBy("email_id").orderBy("seq"))))


def resolve(paths: DataFrame, known: DataFrame, current: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """(email_id, path) with the evidence_id of the path or else of its longest known parent; ``current`` renews old paths."""
    parts = F.split(current(F.col("path")), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    asked = paths.select("email_id", "path", F.explode(parents).alias("parent"))
    found = asked.join(known.select("email_id", F.col("path").alias("parent"), "evidence_id"), ["email_id", "parent"], "left")
    return found.groupBy("email_id", "path").agg(F.max_by("evidence_id", F.when(F.col("evidence_id").isNotNull(), F.length("parent"))).alias("evidence_id"))


def enrich_attachments(signals: DataFrame, reports: DataFrame) -> DataFrame:
    """Signals (email_id, name, ...) left-joined with the last report (email_id, pos, name, type, risk_score, macro_like, ...) of their name."""
    more = [c for c in ("type", "risk_score", "macro_like", "extracted_urls") if c in reports.columns]
    last = reports.groupBy("email_id", "name").agg(*[F.max_by(c, "pos").alias(c) for c in more])
    return signals.join(last, ["email_id", "name"], "left")


def enriched_flags(df: DataFrame) -> DataFrame:
    """What ``enrich_attachments`` joined (with extracted_urls), told in the signal: flags of a type that isn't the name's, of macros and of URLs, and the report's confidence."""
    seen, wrong = F.col("type").isNotNull(), F.coalesce(extension_mismatch(F.col("name"), F.lower("type")), F.lit(False))
    tests = [("extension-mismatch", wrong), ("macro-suspected", F.coalesce("macro_like", F.lit(False))), ("attachment-url-chain", F.coalesce(F.size("extracted_urls") > 0, F.lit(False)))]
    more = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    risk = F.greatest(F.lit(0), F.least(F.lit(100), F.col("risk_score") + F.when(wrong, 12).otherwise(0)))
    sure = F.when(seen, confidence(risk)).otherwise(F.col("confidence"))
    return df.withColumns({"extension_mismatch": wrong, "risk_flags": F.array_distinct(F.concat("risk_flags", more)), "confidence": sure})


def evaluate(df: DataFrame, predicted: str = "predicted", truth: str = "truth", positive: str = "phishing", suspicious_as_positive: bool = True, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row: confusion matrix, accuracy, precision, recall and F1, 0 where a denominator is 0; and ``more`` aggregates."""
    yes = (positive, "suspicious") if suspicious_as_positive else (positive,)
    hit = lambda c: F.lower(strip(F.coalesce(F.col(c), F.lit("")))).isin(*yes)
    p, t = hit(predicted), hit(truth)
    n = df.agg(F.count("*").alias("total"), F.count_if(t).alias("positives"), F.count_if(p & t).alias("tp"), F.count_if(~p & ~t).alias("tn"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), *more)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = n.withColumns({"negatives": F.col("total") - F.col("positives"), "accuracy": share(F.col("tp") + F.col("tn"), F.col("total")), "precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summarize_reports(reports: DataFrame, risky: int = 60) -> DataFrame:
    """A row a message of (email_id, pos, name, risk_score, extracted_urls): counts, risky names and distinct URLs in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "name", "risk_score", "extracted_urls")))
    out = reports.groupBy("email_id").agg(rows.alias("r"))
    names = F.transform(F.filter("r", lambda x: x["risk_score"] >= risky), lambda x: x["name"])
    urls = F.array_distinct(F.flatten(F.transform("r", lambda x: x["extracted_urls"])))
    return out.select("email_id", F.size("r").alias("total"), names.alias("risky"), F.size(names).alias("risky_count"), urls.alias("extracted_urls"))


def run_metrics(df: DataFrame, score: str = "risk_score", source: str = "provider") -> DataFrame:
    """One row over (predicted, truth, score, source): evaluate()'s figures, specificity, mean score, share of fallbacks."""
    fallback = F.coalesce(F.col(source).endswith(":fallback"), F.lit(False))
    share = lambda a: F.coalesce(F.try_divide(a, F.count("*")), F.lit(0.0))
    n = evaluate(df, suspicious_as_positive=False, more=(share(F.sum(score)).alias("mean_risk"), share(F.count_if(fallback)).alias("fallback_rate")))
    return n.withColumn("specificity", F.coalesce(F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")), F.lit(0.0)))


def balanced_sample(df: DataFrame, key: str, label: str, each: int, seed: str) -> DataFrame:
    """``each`` rows of each label, or all it has: those of the smallest salted hash of their key, so reruns agree.

    Spark cuts each partition to ``each`` rows a label before its shuffle, so a label's rows never meet in one task.
    """
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.sha2(F.concat(F.lit(seed + "|"), F.col(key).cast("string")), 256), key))
    return df.withColumn("__n", rank).where(F.col("__n") <= each).drop("__n")
