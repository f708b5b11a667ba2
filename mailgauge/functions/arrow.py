"""What the parsers that run in Arrow batches of Python share: struct columns of a function, and the URLs of a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = re.compile(r"https?://[^\s<>()\[\]{}\"']+", re.I)
_NAMES = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}


def canonical(url: str) -> str:
    url = url.strip()
    try:
        parts = urlsplit(url)
    except ValueError:
        return url
    return urlunsplit(parts._replace(netloc=parts.netloc.lower())) if parts.scheme and parts.netloc else url


def urls_in(text: str) -> list[str]:
    return list(dict.fromkeys(map(canonical, _URL.findall(text))))


def arrow_struct(f: Callable[..., dict | None], fields: dict[str, pa.DataType]) -> Callable[[Column], Column]:
    """A column function that calls ``f`` on each value of an Arrow batch and gives a struct."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([f(v) for v in values.to_pylist()], pa.struct(list(fields.items())))

    return F.arrow_udf(run, "struct<" + ",".join(f"{k}:{_NAMES[t]}" for k, t in fields.items()) + ">")
