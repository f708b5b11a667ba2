"""Table functions, joined laterally: a row a MIME part, an archive's member, an anchor of a page.

They run in Arrow batches of Python, as only parsers read these formats, and give plain rows; scores over them are column
expressions. What a row may unpack is bounded in bytes; what is over a bound is named in column skipped and counts in the scores.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from email import policy
from email.message import Message
from email.parser import BytesParser
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgauge.functions.text import bind
from mailgauge.functions.url import extract_urls, netloc

#: Bytes that one part or member, and all of a message or an archive, may have unpacked; characters shown of an anchor.
MOST_PART, MOST_WHOLE, ANCHOR_CHARS = 4_000_000, 16_000_000, 4_000
#: Points of an archive with members over a bound, whose content no one has seen.
UNSEEN = 20


def _parts(message: Message) -> Iterator[tuple[int, Message]]:
    """(depth, part) of all parts, a part before what it holds; without recursion, however deep they lie."""
    todo = [(0, message)]
    while todo:
        depth, part = todo.pop()
        yield depth, part
        if part.is_multipart():
            todo += [(depth + 1, p) for p in reversed(part.get_payload())]


@F.udtf(returnType="part int, depth int, content_type string, name string, disposition string, size long, sha256 string, text string, skipped string")
class MimeParts:
    """The parts of a raw message that hold data, also inside forwarded messages; text is that of text parts."""

    def eval(self, raw: str):
        if not (raw or "").strip():
            return
        try:
            message = BytesParser(policy=policy.default).parsebytes(raw.encode("utf-8", "ignore"))
            found = list(_parts(message))
        except (RecursionError, ValueError, AttributeError, TypeError) as e:
            yield 0, 0, "", "", "", 0, None, None, type(e).__name__
            return
        left, n = MOST_WHOLE, 0
        for depth, part in found:
            if part.is_multipart():
                continue
            kind, name = part.get_content_type().lower(), " ".join((part.get_filename() or "").split())
            disposition = (part.get("Content-Disposition") or "").split(";")[0].strip().lower()
            packed = part.get_payload()
            if not isinstance(packed, str) or len(packed) * 3 // 4 > min(MOST_PART, left):
                yield n, depth, kind, name, disposition, len(packed or ""), None, None, "over the bound"
            else:
                data = part.get_payload(decode=True) or b""
                left -= len(data)
                try:
                    text = data.decode(part.get_content_charset() or "utf-8", "replace") if kind.startswith("text/") else None
                except LookupError:
                    text = data.decode("utf-8", "replace")
                yield n, depth, kind, name, disposition, len(data), hashlib.sha256(data).hexdigest(), text, None
            n += 1


@F.udtf(returnType="member int, name string, size long, packed long, text string, skipped string")
class ArchiveMembers:
    """The members of a ZIP archive; text is that of XML parts and their relations. No row for what is no archive."""

    def eval(self, data: bytes):
        try:
            archive = zipfile.ZipFile(io.BytesIO(data or b""))
            members = archive.infolist()
        except (zipfile.BadZipFile, ValueError, NotImplementedError, OSError):
            return
        left = MOST_WHOLE
        for n, m in enumerate(members):
            text = skipped = None
            if m.filename.lower().endswith((".xml", ".rels")):
                most = min(MOST_PART, left)
                try:
                    with archive.open(m) as part:
                        # The size that the archive gives may be a lie: what is read tells.
                        read = part.read(most + 1)
                    left -= min(len(read), most)
                    text, skipped = (None, "over the bound") if len(read) > most else (read.decode("utf-8", "ignore"), None)
                except Exception as e:  # an encrypted or broken member
                    skipped = type(e).__name__
            yield n, m.filename, m.file_size, m.compress_size, text, skipped


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self.href, self.text, self.chars = None, [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.href, self.text, self.chars = next((v or "" for k, v in attrs if k == "href"), "").strip(), [], 0

    def handle_data(self, data: str) -> None:
        if self.href and self.chars < ANCHOR_CHARS:
            self.text.append(data[:ANCHOR_CHARS])
            self.chars += len(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.href:
            self.found.append((self.href, " ".join("".join(self.text).split())[:ANCHOR_CHARS]))
        self.href = None if tag == "a" else self.href


@F.udtf(returnType="pos int, href string, shown string")
class Anchors:
    """The links of a page that have an address, with the text they show."""

    def eval(self, html: str):
        page = _Anchors()
        page.feed(html or "")
        for n, (href, shown) in enumerate(page.found):
            yield n, href, shown


def _joined(df: DataFrame, column: str, function: object, made: str) -> DataFrame:
    """``df`` without ``column``, a row for each row of the function; its columns replace those of their names."""
    rest = [c for c in df.columns if c != column and c not in made.split()]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").alias("__of"))
    return rows.lateralJoin(function(F.col("__of").outer())).drop("__of")


def mime_parts(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """``messages`` without ``raw``, a row a part with data: part, depth, content_type, name, disposition, size, sha256, text, skipped."""
    return _joined(messages, raw, MimeParts, "part depth content_type name disposition size sha256 text skipped")


def archive_members(files: DataFrame, data: str = "data") -> DataFrame:
    """``files`` without ``data``, a row a member: member, name, size, packed, text, skipped."""
    return _joined(files, data, ArchiveMembers, "member name size packed text skipped")


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, a row a link: pos, href, shown."""
    return _joined(pages, html, Anchors, "pos href shown")


def hides_target(href: Column, shown: Column) -> Column:
    """Whether a link shows a URL of another authority than its own."""
    own = F.lower(F.regexp_extract(href, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1))
    return bind(own, lambda o: F.exists(extract_urls(shown), lambda u: (netloc(u) != "") & (netloc(u) != o)))


def archive_reports(members: DataFrame, *keys: str) -> DataFrame:
    """(keys, members, macro_like, entries, urls, skipped, risk_score): a row an archive, from its members.

    Fixed points: 40 with a macro's entry, 4 for each URL in XML parts up to 20. Members that no one could read are named
    in skipped and cost UNSEEN points.
    """
    macro = F.lower("name").contains("vba")
    ordered = lambda c, where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("member", F.col(c).alias("v"))))), lambda x: x["v"])
    linked = members.withColumn("links", extract_urls(F.coalesce("text", F.lit(""))))
    out = linked.groupBy(*keys).agg(
        F.count("*").alias("members"), ordered("name", macro).alias("entries"), ordered("links", F.size("links") > 0).alias("l"), ordered("name", F.col("skipped").isNotNull()).alias("skipped"),
    )
    found = F.size(F.flatten("l"))
    points = F.when(F.size("entries") > 0, 40).otherwise(0) + F.least(F.lit(20), found * 4) + F.when(F.size("skipped") > 0, UNSEEN).otherwise(0)
    return out.select(*keys, "members", (F.size("entries") > 0).alias("macro_like"), "entries", F.array_distinct(F.flatten("l")).alias("urls"), "skipped", points.alias("risk_score"))
