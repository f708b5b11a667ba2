"""Header signals: authentication results, reply-to mismatch, relay path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgauge.functions.text import strip

#: Patterns, result words and weights that results depend on.
PRIVATE_IP = r"\b(?:127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[0-1])\.)"


def email_domain(address: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(address, F.lit(""))), r"@([a-z0-9.-]+\.[a-z]{2,})", 1)


def auth_result(source: Column, key: str) -> Column:
    """The last result given for a mechanism, ``none`` without one."""
    found = F.regexp_extract_all(F.lower(source), F.lit(rf"\b{key}\s*=\s*([a-zA-Z_]+)"), F.lit(1))
    return F.coalesce(F.get(found, F.size(found) - 1), F.lit("none"))


def header_signals(auth: Column, headers_raw: Column, sender: Column, reply_to: Column) -> Column:
    """The header struct of a message; ``auth``: its authentication headers joined by blanks."""
    auth, headers_raw = F.coalesce(auth, F.lit("")), F.coalesce(headers_raw, F.lit(""))
    low = F.lower(auth)
    # A folded line, which starts with a blank, is no hop of its own.
    received = F.filter(F.split(headers_raw, r"\r?\n"), lambda x: F.lower(x).startswith("received:"))
    patterns = [
        ("missing_received_headers", (strip(headers_raw) != "") & (F.size(received) == 0)),
        ("unusually_long_received_chain", F.size(received) >= 9),
        ("private_ip_in_received_chain", F.exists(received, lambda x: x.rlike(PRIVATE_IP))),
        ("localhost_received_hop", F.exists(received, lambda x: F.lower(x).contains("localhost"))),
    ]
    results = {k: auth_result(auth, k) for k in ("spf", "dkim", "dmarc")}
    good = sum((r.isin("pass", "bestguesspass").cast("int") for r in results.values()), F.lit(0))
    bad = sum((r.isin("fail", "softfail").cast("int") for r in results.values()), F.lit(0))
    a, b = email_domain(sender), email_domain(reply_to)
    return F.struct(
        *[r.alias(k) for k, r in results.items()],
        email_domain(F.regexp_extract(low, r"\bsmtp\.mailfrom=([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})", 1)).alias("spf_domain"),
        F.regexp_extract(low, r"\bd=([a-z0-9.-]+\.[a-z]{2,})", 1).alias("dkim_domain"),
        F.regexp_extract(low, r"\bp=([a-z]+)\b", 1).alias("dmarc_policy"),
        ((a != "") & (b != "") & (a != b)).alias("mismatch"),
        F.size(received).alias("hops"),
        F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in patterns])).alias("received_patterns"),
        F.least(F.lit(1.0), 0.35 + 0.15 * good + 0.1 * bad).alias("confidence"),
    )
