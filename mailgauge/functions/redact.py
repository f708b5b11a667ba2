"""Redaction of every string inside JSON documents, in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgauge.functions import lexicon as L

#: What is masked or hidden.
_ADDRESS = re.compile(r"\b([a-z0-9._%+-]{1,2})[a-z0-9._%+-]{0,62}@([a-z0-9.-]+\.[a-z]{2,})\b", re.I)
_TOKEN = re.compile(r"\b[A-Za-z0-9_-]{30,}\b", re.A)
#: The longest query value that is shown.
SHOWN = 24


def _url(url: str) -> str:
    try:
        parts = urlsplit(url)
    except ValueError:
        return _ADDRESS.sub(r"\1***@\2", url)
    if not parts.netloc:
        return _ADDRESS.sub(r"\1***@\2", url)
    pairs = parse_qsl(parts.query, keep_blank_values=True)
    secret = lambda k, v: k.lower() in L.TOKEN_KEYS or len(v) > SHOWN
    digest = lambda v: f":{hashlib.sha256(v.encode('utf-8', 'ignore')).hexdigest()[:12]}" if v else ""
    query = urlencode([(k, f"<redacted{digest(v)}>" if secret(k, v) else v) for k, v in pairs])
    return _ADDRESS.sub(r"\1***@\2", urlunsplit(parts._replace(query=query, fragment="")))


def redacted(value):
    """``value`` with all its strings redacted at any depth; keys and other values stay."""
    if isinstance(value, dict):
        return {k: redacted(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v) for v in value]
    if not isinstance(value, str):
        return value
    return _url(value) if value.startswith(("http://", "https://")) else _TOKEN.sub("<redacted-token>", _ADDRESS.sub(r"\1***@\2", value))


def _document(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(redacted(json.loads(text)), ensure_ascii=False)
    except (ValueError, RecursionError):
        return redacted(text)


def redact_json(column: Column) -> Column:
    """The JSON text with every string in it redacted; text that isn't JSON is redacted as one string, null stays."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_document(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(column)
