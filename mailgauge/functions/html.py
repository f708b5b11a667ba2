"""HTML features by a parser in Arrow batches, and the scores over them as column expressions."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgauge.functions import lexicon as L
from mailgauge.functions.arrow import arrow_struct, canonical, urls_in
from mailgauge.functions.url import confidence

#: Fixed bounds: characters and pieces of visible text, links, snippets and their length.
TEXT_CHARS, PIECES, LINKS, SNIPPETS, SNIPPET_CHARS = 20_000, 1_000, 40, 8, 280
#: Fixed bound: characters that are searched for words, behind references and two rounds of percent-encoding.
LAYERED_CHARS = 12_000
#: Points that make a piece of text worth showing.
SNIPPET_POINTS = ((5, ("password",)), (4, ("verify",)), (4, ("login",)), (3, ("mfa", "otp")), (3, ("invoice", "payment")), (2, ("urgent", "immediately")))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.n = dict.fromkeys(("forms", "passwords", "otps", "iframes", "external_scripts", "external_links", "data_uris"), 0)
        self.title, self.refresh, self.pieces, self.left = "", False, [], TEXT_CHARS
        self.links, self.hrefs, self.anchors = [], [], []
        self._hidden, self._titled, self._anchor = 0, False, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: (v or "").strip() for k, v in attrs}
        if tag == "title":
            self._titled = True
            return
        self._hidden += tag in ("script", "style", "noscript")
        outside = lambda x: x.lower().startswith(("http://", "https://", "//"))
        kind, name = a.get("type", "").lower(), a.get("name", "").lower()
        self.n["forms"] += tag == "form"
        self.n["iframes"] += tag == "iframe"
        if tag == "input":
            self.n["passwords"] += kind == "password"
            self.n["otps"] += "otp" in kind or "otp" in name or "code" in name
        if tag == "script" and outside(a.get("src", "")):
            self.n["external_scripts"] += 1
            self.links.append(a["src"])
        if tag in ("a", "link") and outside(a.get("href", "")):
            self.n["external_links"] += 1
            self.links.append(a["href"])
        if tag == "a":
            self._anchor = (a.get("href", ""), [])
            if a.get("href", "").startswith(("http://", "https://")):
                self.hrefs.append(a["href"])
        self.refresh |= tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and bool(a.get("content"))
        self.n["data_uris"] += sum(v.lower().startswith("data:") for v in a.values())

    def handle_endtag(self, tag: str) -> None:
        self._titled &= tag != "title"
        self._hidden -= bool(self._hidden) and tag in ("script", "style", "noscript")
        if tag == "a" and self._anchor and self._anchor[0]:
            self.anchors.append((self._anchor[0], " ".join("".join(self._anchor[1]).split())))
        self._anchor = None if tag == "a" else self._anchor

    def handle_data(self, data: str) -> None:
        if self._anchor:
            self._anchor[1].append(data)
        text = " ".join(data.split())
        if text and self._titled and not self.title:
            self.title = text[:160]
        if text and not self._hidden and self.left > 0 and len(self.pieces) < PIECES:
            self.pieces.append(text[: self.left])
            self.left -= len(self.pieces[-1])


def _domain(url: str) -> str:
    return canonical(url).partition("://")[2].split("/")[0].split("?")[0].split("#")[0].lower()


def features(html: str | None) -> dict:
    """Counts, title, visible text, words of risk and brands, snippets in order of points, links and hidden links of a page."""
    p = _Page()
    p.feed(html or "")
    low = " ".join(p.pieces)[:LAYERED_CHARS]
    for layer in (unescape, unquote, unquote):
        low = layer(low)[:LAYERED_CHARS]
    low = low.lower()
    words, brands = [w for w in L.HTML_KEYWORDS if w in low], [b for b in L.HTML_BRANDS if b in low]
    rated = []
    for i, piece in enumerate(p.pieces):
        t = piece.lower()
        points = sum(n for n, ws in SNIPPET_POINTS if any(w in t for w in ws)) + 2 * any(b in t for b in brands)
        rated += [(-points, i, piece)] * (points > 0)
    shown = [x for *_, x in sorted(rated)[:SNIPPETS]] or p.pieces[:SNIPPETS]
    hidden = [h for h, t in p.anchors for u in urls_in(t) if _domain(u) and _domain(u) != _domain(h)]
    domains = [d for d in (_domain("http:" + x if x.startswith("//") else x).split("@")[-1].split(":")[0] for x in p.links) if d]
    lists = {"keywords": words, "brands": brands, "snippets": [s[:SNIPPET_CHARS] for s in shown], "domains": domains[:LINKS], "urls": [*p.hrefs, *urls_in(html or "")], "hidden_links": hidden}
    return p.n | {"data_uris": min(3, p.n["data_uris"]), "title": p.title, "refresh": p.refresh, "text_chars": TEXT_CHARS - p.left} | {k: list(dict.fromkeys(v)) if k != "snippets" else v for k, v in lists.items()}


_LIST = pa.list_(pa.string())
FIELDS = {k: pa.int32() for k in ("forms", "passwords", "otps", "iframes", "external_scripts", "external_links", "data_uris", "text_chars")} | {"title": pa.string(), "refresh": pa.bool_()} | {k: _LIST for k in ("keywords", "brands", "snippets", "domains", "urls", "hidden_links")}


def features_column(html: Column) -> Column:
    return arrow_struct(features, FIELDS)(html)


def impersonation_score(f: str) -> Column:
    """0 to 100 from the features struct named ``f``."""
    c = lambda n: F.col(f"{f}.{n}")
    least = lambda cap, x: F.least(F.lit(cap), x)
    points = least(20, c("forms") * 8) + least(20, c("passwords") * 12) + least(15, c("external_scripts") * 5) + least(10, c("iframes") * 5) + least(20, F.size(c("keywords")) * 6)
    asks = (c("passwords") > 0) | (c("forms") > 0)
    points = points + F.when((F.size(c("brands")) > 0) & asks, 15).otherwise(0) + F.when(c("refresh"), 4).otherwise(0) + F.when(c("data_uris") > 0, 3).otherwise(0)
    return F.least(F.lit(100), points)


def web_signal(f: str, status: Column, obfuscated: Column) -> Column:
    """Flags and confidence of a page from its features, the status of its fetch and whether its URL hides something."""
    c = lambda n: F.col(f"{f}.{n}")
    ok, asks = status == "ok", (c("passwords") > 0) | (c("forms") > 0)
    flags = [("credential-harvest", ok & (c("passwords") > 0) & (c("forms") > 0)), ("otp-collection", ok & (c("otps") > 0)), ("brand-impersonation", ok & (F.size(c("brands")) > 0) & asks), ("fetch-anomaly", ~status.isin("ok", "http_error"))]
    risk = F.when(status.isin("blocked", "network_error", "timeout", "sandbox_error"), 20).otherwise(0) + F.when(ok, (impersonation_score(f) * 0.6).cast("int")).otherwise(0) + F.when(obfuscated, 6).otherwise(0)
    risk = F.least(F.lit(100), risk)
    return F.struct(risk.alias("risk"), F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in flags])).alias("risk_flags"), F.when(ok, confidence(risk, 0.04)).otherwise(confidence(risk, -0.05)).alias("confidence"))
