"""The tools as SQL functions of a session: named expressions that the optimiser inlines, without Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mailgauge.functions import decode as D
from mailgauge.functions import text as T
from mailgauge.functions import url as U
from mailgauge.operators import stages as G
from mailgauge.sources.plain import plain_message

_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')", re.S)
_OPERATOR = re.compile(r"(?<![\w`])(<=>|[<>!]=|[-+*/%=<>!&|^~]|and|or|not|in)\(")


def sql_of(column: Column) -> str:
    """The SQL text of an expression over names: operators, which it shows as calls, by their quoted names."""
    shown = str(column).removeprefix("Column<'").removesuffix("'>")
    parts = _LITERAL.split(shown)
    return "".join(p if k % 2 else _OPERATOR.sub(r"`\1`(", p) for k, p in enumerate(parts))


def url_target(url: Column, fetched: Column) -> Column:
    """What is known of a URL without fetching it: struct(url, status, refused, hidden, risk_score)."""
    refused = F.when(T.strip(F.coalesce(url, F.lit(""))) == "", "empty_url").when(fetched, U.fetch_refusal(url))
    status = F.when(refused.isNotNull(), "blocked").when(~fetched, "skipped").otherwise("not_fetched")
    found = lambda hidden: F.struct(url.alias("url"), status.alias("status"), refused.alias("refused"), hidden.alias("hidden"), (F.when(refused.isNotNull(), 20).otherwise(0) + F.when(F.size(hidden["flags"]) > 0, 6).otherwise(0)).alias("risk_score"))
    return T.bind(D.obfuscation(url), found)


@T.once
def _functions() -> dict[str, tuple[str, Column, str]]:
    """(parameters, body, what it is for) by name, in a fixed order; parse_email reads all but MIME messages, which give null."""
    c = F.col
    texts = F.coalesce(c("urls"), F.array().cast("array<string>")), F.coalesce(c("attachments"), F.array().cast("array<string>"))
    return {
        "normalize_text": ("text STRING", T.normalize(c("text")), "runs of white space to one blank"),
        "keyword_scan": ("text STRING", G.keyword_scan(c("text")), "words of phishing in a text"),
        "route_path": ("text STRING, urls ARRAY<STRING>, attachments ARRAY<STRING>", G.TOOLS["route_path"](c("text"), *texts), "FAST, STANDARD or DEEP"),
        "extract_urls": ("text STRING", G.TOOLS["extract_urls"](c("text")), "the URLs of a text"),
        "check_url": ("url STRING", G.TOOLS["check_url"](c("url")), "whether a URL looks odd"),
        "attachment_risk": ("filename STRING", G.TOOLS["attachment_risk"](c("filename")), "the risk of a file name"),
        "parse_email": ("raw STRING", plain_message(c("raw")), "the fields of a message"),
        "url_target": ("url STRING, enable_fetch BOOLEAN", url_target(c("url"), F.coalesce(c("enable_fetch"), F.lit(False))), "what a URL is known to lead to"),
        "domain_intel": ("url STRING", G.TOOLS["domain_intel"](c("url")), "the domain of a URL and its risk"),
        "attachments_deep": ("attachments ARRAY<STRING>", G.TOOLS["attachments_deep"](texts[1]), "reports of attachments by their names"),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the session's functions, once; their names, as SHOW USER FUNCTIONS lists them."""
    made = _functions()
    if all(spark.catalog.functionExists(name) for name in made):
        return list(made)
    for name, (parameters, body, about) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) COMMENT '{about}' RETURN {sql_of(body)}")
    return list(made)
