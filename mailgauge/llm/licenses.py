"""Operator 6: licence scans by Aho-Corasick and a parser of licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm.common import table

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases, as words, and the labels that they add.
NOTICES = {
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3.0",
    "mozilla public license version 2": "mpl-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0-1.0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: How far a licence binds, 0 to 1, by the start of its identifier; the longest start counts.
BINDS = {
    "mit": 0.1, "bsd": 0.1, "isc": 0.1, "zlib": 0.1, "unlicense": 0.0, "cc0": 0.0, "apache": 0.15, "cc-by": 0.2, "cc-by-sa": 0.6,
    "cc-by-nc": 0.8, "mpl": 0.5, "epl": 0.5, "lgpl": 0.6, "gpl": 0.8, "agpl": 0.9, "public-domain": 0.0, "all-rights-reserved": 1.0,
}
#: An exception named after ``with`` loosens a licence by this much.
EXCEPTION = 0.2
TAG = "spdx license identifier"
_ORDER = {"or": 1, "and": 2, "with": 3}
_WORD_BYTES = bytes(c if c > 0x7F or chr(c).isdigit() or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_TAG_TEXT = re.compile(rb"spdx-license-identifier\s*:\s*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")


class Bad(ValueError):
    """The expression can't be parsed."""


def postfix(text: str) -> list[str]:
    """Shunting-yard: the identifiers and operators of a licence expression in postfix order, lower case; ``with`` binds closest, ``or`` least."""
    out, held, operand = [], [], False
    for token in (x.lower() for x in _TOKEN.findall(text)):
        if token in _ORDER or token == ")":
            if not operand:
                raise Bad(text)
            while held and held[-1] != "(" and (token == ")" or _ORDER[held[-1]] >= _ORDER[token]):
                out.append(held.pop())
            if token == ")":
                if not held:
                    raise Bad(text)
                held.pop()
            else:
                held.append(token)
                operand = False
            continue
        if operand:
            raise Bad(text)
        if token == "(":
            held.append(token)
        else:
            out.append(token)
            operand = True
    if not operand or "(" in held:
        raise Bad(text)
    return out + held[::-1]


def leading(text: str) -> str:
    """The longest start of ``text`` that parses, all of it if none does; in one pass.

    A start ends behind an operand outside of parentheses. What a ``with`` is followed by must be one identifier, also
    in parentheses; where it isn't, no longer start parses. Of the identifiers of a parenthesis two are held, as one or
    more is all that counts.
    """
    end, operand, groups, exception = len(text), False, [set()], [False]
    known = False
    for found in _TOKEN.finditer(text):
        token = found.group().lower()
        if token in _ORDER:
            if not operand:
                break
            operand, exception[-1] = False, token == "with"
        elif token == "(":
            if operand:
                break
            groups.append(set())
            exception.append(False)
        elif token == ")":
            if not operand or len(groups) == 1:
                break
            inner, _ = groups.pop(), exception.pop()
            if exception[-1] and len(inner) != 1:
                break
            if not exception[-1] and len(groups[-1]) < 2:
                groups[-1].update(inner)
        else:
            if operand:
                break
            operand = True
            if not exception[-1] and len(groups[-1]) < 2:
                groups[-1].add(token)
        if operand and len(groups) == 1:
            end, known = found.end(), True
    return text[:end] if known else text


def binds(identifier: str) -> float:
    return max(((len(k), v) for k, v in BINDS.items() if identifier.startswith(k)), default=(0, 1.0))[1]


def evaluate(text: str) -> tuple[set[str], float]:
    """The identifiers of an expression and how far it binds: and takes the stricter side, or the looser, with loosens.

    The larger side's set takes in the smaller one's, so a long chain costs what its identifiers do.
    """
    stack: list[tuple[set[str], float]] = []
    for token in postfix(text):
        if token not in _ORDER:
            stack.append(({token}, binds(token)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        if token == "with" and len(b) != 1:
            raise Bad(text)
        if token == "with":
            stack.append((a, max(0.0, x - EXCEPTION)))
            continue
        both, fewer = (a, b) if len(a) >= len(b) else (b, a)
        both.update(fewer)
        stack.append((both, min(x, y) if token == "or" else max(x, y)))
    return stack[0]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def read_tags(raw: bytes) -> tuple[set[str], float, float | None]:
    """Identifiers, score and binding of all identifier tags of a text; each different tag line is parsed once."""
    labels, score, bind = set(), 0.0, None
    for line in set(_TAG_TEXT.findall(raw)):
        try:
            ids, x = evaluate(leading(line.decode("utf-8", "replace").split("*/")[0].split("-->")[0]))
            labels |= ids
            score, bind = 1.0, x if bind is None else max(bind, x)
        except Bad:
            score = max(score, 0.3)
    return labels, score, bind


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, binding of one text, in time linear in its length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORD_BYTES).split()
    line = b" %b " % b" ".join(words)
    blanks, tags, base, labels, score, bind = [], False, set(), set(), 0.0, None
    for end, phrase in automaton().iter(line.decode("latin-1")):
        if phrase in BASE:
            blanks.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
        elif phrase in NOTICES:
            labels.add(NOTICES[phrase])
            score = 0.8
        else:
            tags = True
    if base:
        score = 0.9
    if tags:
        found, sure, bind = read_tags(raw)
        labels, score = labels | found, max(score, sure)
    labels |= base
    if bind is None and labels:
        bind = max(map(binds, labels))
    # A phrase's start, in words: the blanks before the one in front of it.
    starts = np.searchsorted(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), blanks) if blanks else np.zeros(0, np.int64)
    first, last = (int(starts.min()), int(starts.max())) if len(starts) else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, bind


_FIELDS = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("binding", "double")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def scan_documents(docs: DataFrame) -> DataFrame:
    """``docs`` plus struct ``licence`` with what scan() finds in column text; null counts as empty.

    labels: those of notice phrases and base phrases, and the lower-case identifiers of SPDX tags. score,
    0 to 1: 1 with an identifier tag that parses, 0.9 with a base phrase, 0.8 with another notice, 0.3 with
    a tag of which no start parses, else 0. binding: how far the licence found binds (null: none), by the tags'
    expressions or else the strictest label. Row by row, without a shuffle. A column ``licence`` of the input is
    replaced; other columns pass through. Repeated rows get equal results. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = list(zip(*(scan(t.as_py()) for t in texts), strict=True)) or [[]] * len(_FIELDS)
            yield pa.StructArray.from_arrays([pa.array(x, _ARROW[k]) for x, (_, k) in zip(rows, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    return docs.withColumn("licence", F.arrow_udf(run, ", ".join(f"{n} {k}" for n, k in _FIELDS))("text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licence.*")
