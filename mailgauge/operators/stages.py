"""Named stages over DataFrames, a whitelist of them, and the fixed chain; named tools over columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgauge.functions import attachment as A
from mailgauge.functions import decode as D
from mailgauge.functions import header as H
from mailgauge.functions import lexicon as L
from mailgauge.functions import text as T
from mailgauge.functions import url as U
from mailgauge.operators import score as S
from mailgauge.plans.triage import NO_SIGNALS, barrier, filled, with_url_signals
from mailgauge.sources.messages import parse_column

MOST_STEPS = 5


class UnknownStage(KeyError):
    """A stage that isn't registered was asked for."""


@dataclass
class Stages:
    """Stages by name; where ``allowed`` isn't empty, only names in it."""

    allowed: frozenset[str] = frozenset()
    _known: dict[str, tuple[str, Callable]] = field(default_factory=dict)

    def register(self, name: str, run: Callable[..., DataFrame], description: str = "", steps: int = MOST_STEPS) -> None:
        name = name.strip()
        if not name or not 1 <= steps <= MOST_STEPS:
            raise ValueError(f"stage {name!r} needs a name and 1 to {MOST_STEPS} steps")
        if (self.allowed and name not in self.allowed) or name in self._known:
            raise ValueError(f"stage {name!r} isn't allowed or is there already")
        self._known[name] = (description, run)

    def run(self, name: str, df: DataFrame, **options) -> DataFrame:
        if name.strip() not in self._known:
            raise UnknownStage(name)
        return self._known[name.strip()][1](df, **options)

    def chain(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """The stages one after the other, by default all in order of registration."""
        for name in self.names() if names is None else names:
            df = self.run(name, df)
        return df

    def names(self) -> list[str]:
        return list(self._known)

    def describe(self) -> dict[str, str]:
        return {n: d for n, (d, _) in self._known.items()}


def _surface(df: DataFrame) -> DataFrame:
    df = filled(df)
    out = barrier(df, urls=U.extract_urls(F.col("text")), raw=T.cue_text(F.col("subject"), F.col("text"), F.lit("")))
    names = F.filter(F.array(T.strip(F.col("attachment"))), lambda x: x != "")
    return barrier(out, low=F.lower("raw"), chain_flags=S.chain_flags(F.col("urls"), names, F.lit("")))


def _headers(df: DataFrame) -> DataFrame:
    return barrier(df, header=H.header_signals(F.col("auth"), F.col("received"), F.col("sender"), F.col("reply_to")))


def _urls(df: DataFrame) -> DataFrame:
    return with_url_signals(df, S.Policy())


def _cues(df: DataFrame) -> DataFrame:
    return barrier(df, cues=F.struct(*T.nlp_cues(F.col("subject"), F.col("raw"), F.col("low"))))


def _files(df: DataFrame) -> DataFrame:
    return barrier(df, files=F.filter(F.array(A.signal(T.strip(F.col("attachment")))), lambda s: s["filename"] != ""))


def _pages(df: DataFrame) -> DataFrame:
    """Page signals that the input brings along, none otherwise; nothing is fetched."""
    return df if "web_signals" in df.columns else df.withColumn("web_signals", F.array().cast(NO_SIGNALS))


def _deep(df: DataFrame) -> DataFrame:
    """URLs found in attachments become signals of their own, appended without a check for repeats."""
    if "attachment_urls" not in df.columns:
        return df
    mark = lambda s: s.withField("risk_flags", F.array_append(s["risk_flags"], F.lit("nested_url_in_attachment")))
    more = F.transform(F.coalesce("attachment_urls", F.array().cast("array<string>")), lambda u: mark(U.url_signal(u, hidden=D.obfuscation(u))))
    own = barrier(df.withColumnsRenamed({"url_signals": "__own", "chain_flags": "__flags"}), url_signals=F.concat("__own", more), chain_flags=F.when(F.size("attachment_urls") > 0, F.array_append("__flags", F.lit("nested_url_in_attachment"))).otherwise(F.col("__flags")))
    return own.drop("__own", "__flags")


def _fuse(df: DataFrame) -> DataFrame:
    return barrier(df, pre_score=S.pre_score(F.col("header"), F.col("url_signals"), F.col("web_signals"), F.col("files"), F.col("cues")))


def fixed_chain() -> Stages:
    """The eight stages from a message to its first score, in order."""
    steps = {
        "email_surface": (_surface, "URLs, text to search and chain flags"),
        "header_analysis": (_headers, "authentication results and relay path"),
        "url_risk": (_urls, "a signal of each URL"),
        "nlp_cues": (_cues, "cues of pressure and of asking for credentials"),
        "attachment_surface": (_files, "a signal of each attachment's name"),
        "page_content": (_pages, "signals of pages fetched before"),
        "attachment_deep": (_deep, "URLs found in attachments"),
        "risk_fusion": (_fuse, "score, route and reasons"),
    }
    out = Stages(frozenset(steps))
    for name, (run, description) in steps.items():
        out.register(name, run, description)
    return out


def keyword_scan(text: Column) -> Column:
    """struct(is_suspicious, matches, count)."""
    found = T.keywords_found(F.lower(F.coalesce(text, F.lit(""))), L.PHISHING_WORDS)
    return F.struct((F.size(found) > 0).alias("is_suspicious"), found.alias("matches"), F.size(found).alias("count"))


def _route(text: Column, urls: Column, attachments: Column) -> Column:
    odd, n = F.size(F.filter(urls, U.is_suspicious)), F.size(urls)
    return S.heuristic_path(text, odd, n, F.size(attachments), F.lit(0), F.lit(0), S.chain_flags(urls, attachments, F.lit("")))


def _intel(url: Column) -> Column:
    host = U.hostname(url)
    return F.struct(host.alias("domain"), U.base_domain(host).alias("base_domain"), U.domain_risk(host).alias("risk_score"), U.domain_indicators(host).alias("indicators"))


def _deep_reports(names: Column) -> Column:
    """The reports of attachments of which only the names are known."""
    no_bytes, no_archive = F.lit(None).cast("binary"), F.lit(None).cast("struct<risk_score:int,urls:array<string>>")
    return F.transform(names, lambda n: A.report(n, no_bytes, A.magic_type(no_bytes, n), F.lit(0), no_archive, F.lit(""), F.array().cast("array<string>"), F.lit("")))


#: Column functions by the name of the tool, in a fixed order.
TOOLS: dict[str, Callable[..., Column]] = {
    "normalize_text": T.normalize,
    "keyword_scan": keyword_scan,
    "route_path": _route,
    "extract_urls": lambda t: F.struct(U.extract_urls(t).alias("urls"), F.size(U.extract_urls(t)).alias("count")),
    "check_url": lambda u: F.struct(u.alias("url"), U.is_suspicious(u).alias("suspicious")),
    "attachment_risk": lambda n: F.struct(n.alias("filename"), A.classify(n).alias("risk")),
    "parse_email": parse_column,
    "domain_intel": _intel,
    "attachments_deep": _deep_reports,
}


def tool(name: str, *columns: Column) -> Column:
    if name not in TOOLS:
        raise UnknownStage(name)
    return TOOLS[name](*columns)
