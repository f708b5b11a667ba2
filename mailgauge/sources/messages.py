"""Raw messages (plain text, header block, JSON, EML) to the fixed e-mail schema."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from email import policy
from email.parser import BytesParser
from email.utils import getaddresses

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.functions.arrow import urls_in
from mailgauge.functions.html import features
from mailgauge.functions.text import barrier, strip
from mailgauge.sources.plain import HEADER_KEYS, LISTS, MAPS, SCHEMA, TEXTS, json_object, needs_parser, plain_message, string_at

ARROW = pa.struct([*((n, pa.string()) for n in TEXTS), *((n, pa.list_(pa.string())) for n in LISTS), *((n, pa.map_(pa.string(), pa.string())) for n in MAPS), ("parse_error", pa.string())])


def _distinct(xs) -> list[str]:
    return list(dict.fromkeys(x for x in xs if x))


def _addresses(raw: str) -> list[str]:
    return _distinct(" ".join(a.split()) for _, a in getaddresses([raw]))


def empty(**known) -> dict:
    return {n: "" for n in TEXTS} | {n: [] for n in LISTS} | {n: {} for n in MAPS} | {"parse_error": None} | known


def from_eml(raw: str) -> dict:
    """RFC 5322 and MIME: headers, bodies, attachment names and their SHA-256."""
    m = BytesParser(policy=policy.default).parsebytes(raw.encode("utf-8", "ignore"))
    pairs = [(k, str(v)) for k, v in m.items()]
    out = empty(format="eml", headers={k.lower(): v for k, v in pairs}, headers_raw="\n".join(f"{k}: {v}" for k, v in pairs))
    for key, name in HEADER_KEYS.items():
        value = str(m.get(key) or "")
        out[name] = _addresses(value) if name in LISTS else value
    bodies = {"text/plain": [], "text/html": []}
    for part in m.walk():
        data = None if part.get_content_maintype() == "multipart" else part.get_payload(decode=True)
        if name := " ".join((part.get_filename() or "").split()):
            out["attachments"].append(name)
            if data:
                out["attachment_hashes"][name] = hashlib.sha256(data).hexdigest()
        if data and "attachment" not in (part.get("Content-Disposition") or "").lower():
            try:
                text = data.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                text = data.decode("utf-8", "replace")
            bodies.get(part.get_content_type().lower(), []).append(text)
    out["body_text"], out["body_html"] = ("\n".join(bodies[k]) for k in ("text/plain", "text/html"))
    out["urls"] = _distinct([*urls_in(out["body_text"]), *features(out["body_html"])["urls"]])
    out["attachments"] = _distinct(out["attachments"])
    return _backfill(out)


def _backfill(out: dict) -> dict:
    out["text"] = out["text"] or out["body_text"] or out["body_html"]
    return out


def from_json(payload: dict, file: str | None = None) -> dict:
    """Fields of the right type over those of an embedded EML, or else of ``file``, if there is one."""
    eml = payload.get("eml") or payload.get("eml_raw")
    eml = eml if isinstance(eml, str) and eml.strip() else file
    out = from_eml(eml) if isinstance(eml, str) and eml.strip() else empty()
    out["format"] = "json"
    if isinstance(payload.get("headers"), dict):
        out["headers"] |= {str(k).lower(): str(v) for k, v in payload["headers"].items()}
        out["headers_raw"] = "\n".join(f"{k}: {v}" for k, v in out["headers"].items())
    for name in ("subject", "sender", "reply_to", "return_path", "message_id", "date", "body_html", "body_text", "text"):
        value = payload.get(name)
        if isinstance(value, str) and value.strip():
            out[name] = value if name in ("body_html", "body_text", "text") else value.strip()
            out["urls"] += features(value)["urls"] if name == "body_html" else urls_in(value) if name in ("body_text", "text") else []
    for name in ("to", "cc"):
        if isinstance(payload.get(name), list):
            out[name] = _distinct(x.strip() for x in payload[name] if isinstance(x, str))
    if isinstance(payload.get("urls"), list):
        out["urls"] += [str(x).strip() for x in payload["urls"]]
    if isinstance(payload.get("attachments"), list):
        names = [x if isinstance(x, str) else str(x.get("name") or x.get("filename") or "") if isinstance(x, dict) else "" for x in payload["attachments"]]
        out["attachments"] += [n.strip() for n in names]
    out["urls"], out["attachments"] = _distinct(out["urls"]), _distinct(out["attachments"])
    return _backfill(out)


def from_header_block(raw: str) -> dict | None:
    """Known header lines, with a subject among them, up to a blank or other line, then the body; None if it isn't so."""
    lines = raw.replace("\r\n", "\n").lstrip("\n").split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    headers: dict[str, str] = {}
    while lines and lines[0].strip():
        key, colon, value = lines[0].partition(":")
        if not colon or key.strip().lower() not in HEADER_KEYS:
            break
        headers[key.strip().lower()] = value.strip()
        lines.pop(0)
    if "subject" not in headers:
        return None
    out = empty(format="header_block", headers=headers, headers_raw="\n".join(f"{k}: {v}" for k, v in headers.items()), text=raw.strip(), body_text="\n".join(lines).strip())
    for key, name in HEADER_KEYS.items():
        out[name] = _addresses(headers.get(key, "")) if name in LISTS else headers.get(key, "")
    out["urls"] = urls_in(out["text"] + "\n" + out["body_text"])
    return out


def looks_like_eml(raw: str) -> bool:
    head, blank, _ = raw.replace("\r\n", "\n").lstrip().partition("\n\n")
    head = head.lower()
    return bool(blank) and "subject:" in head and ("from:" in head or "to:" in head)


def parse(raw: str | None, file: str | None = None) -> dict:
    """The e-mail in a raw message; a message that can't be parsed gives its text and the reason."""
    text = (raw or "").strip()
    if not text:
        return empty(format="empty")
    try:
        if text[0] + text[-1] == "{}":
            try:
                payload = json.loads(text)
            except ValueError:
                payload = None
            if isinstance(payload, dict):
                return from_json(payload, file)
        if looks_like_eml(raw):
            return from_eml(raw)
        if (found := from_header_block(raw)) is not None:
            return found
    except Exception as e:  # a bad row gives a row, not a failed task
        return empty(format="error", text=text, parse_error=f"{type(e).__name__}: {e}"[:200])
    clean = " ".join(text.split())
    return empty(format="text", text=clean, urls=urls_in(clean))


def parse_column(raw: Column, file: Column | None = None) -> Column:
    """The e-mail in a raw message as a struct, parsed in Arrow batches; ``file``: the message that its eml_path names."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for raws, files in batches:
            rows = [parse(r, f) for r, f in zip(raws.to_pylist(), files.to_pylist(), strict=True)]
            yield pa.array([r | {n: list(r[n].items()) for n in MAPS} for r in rows], ARROW)

    return F.arrow_udf(run, SCHEMA)(raw, F.lit(None).cast("string") if file is None else file)


def parse_messages(df: DataFrame, raw_col: str = "raw", files: DataFrame | None = None) -> DataFrame:
    """``df`` plus the columns of the e-mail schema, parsed from ``raw_col``.

    JSON objects, header blocks and plain texts are read by column expressions; only messages with MIME parts, links in
    HTML or unusual addresses go through Arrow batches of Python. ``files`` (path, raw): messages that the eml_path of a
    JSON object may name; without a match, or without ``files``, such a path is ignored. Null messages are empty ones.
    """
    asked = barrier(df, __parser=needs_parser(F.col(raw_col)))
    plain = barrier(asked.where("not __parser").select(*df.columns), __m=plain_message(F.col(raw_col)))
    rest = asked.where("__parser").select(*df.columns)
    if files is None:
        rest = rest.withColumn("__m", parse_column(F.col(raw_col)))
    else:
        named = rest.withColumn("__path", strip(string_at(json_object(F.col(raw_col)), "$.eml_path")))
        named = named.join(files.select(F.col("path").alias("__path"), F.col("raw").alias("__file")), "__path", "left")
        rest = named.withColumn("__m", parse_column(F.col(raw_col), F.col("__file"))).select(*df.columns, "__m")
    return plain.unionByName(rest).select(*df.columns, "__m.*")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw and e-mail columns) of a folder of message files, each one message."""
    files = spark.read.format("binaryFile").load(path)
    return parse_messages(files.select("path", F.decode("content", "UTF-8").alias("raw")))


def read_attachments(spark: SparkSession, path: str, head_bytes: int = 4_000_000) -> DataFrame:
    """(path, name, size, sha256, head) of a folder of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.substring("content", 1, head_bytes).alias("head"))


def write_json(df: DataFrame, path: str, private: tuple[str, ...] = ("evidence",)) -> None:
    """The results as JSON lines without the private columns."""
    df.drop(*private).write.mode("overwrite").json(path)


#: Fields of nested records that results for the outside don't show.
PRIVATE_REPORT, PRIVATE_FETCH = ("exists", "sha256", "details"), ("stderr", "command")


def sanitize(df: DataFrame) -> DataFrame:
    """``df`` without the column evidence and without private fields of its attachment and URL reports (arrays of structs)."""
    fields = lambda c: {f.name for f in df.schema[c].dataType.elementType.fields}
    made = {}
    if "attachment_reports" in df.columns:
        made["attachment_reports"] = F.transform("attachment_reports", lambda r: r.dropFields(*PRIVATE_REPORT))
    if "url_target_reports" in df.columns and "fetch" in fields("url_target_reports"):
        made["url_target_reports"] = F.transform("url_target_reports", lambda r: r.withField("fetch", r["fetch"].dropFields(*PRIVATE_FETCH)))
    return df.withColumns(made).drop("evidence")
