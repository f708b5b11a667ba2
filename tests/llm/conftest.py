import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bands int, fp int, size int, __id int, tag string"
P = "The quick brown fox jumps over the lazy dog while seven wizards box daily and nobody quite knows why that ever happens at all."
TEXTS = [
    (0, f"{P}\nA second line that is long enough.\nshort", "en", "a"),
    (1, f"  {P.upper()} \nA second line that is long enough.\nshort", "en", "b"),
    (2, f"{P}\nA second line that is long enough.\t", "de", None),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \n\t ", "fr", "b"),
    (6, P, "en", "a"),
    (6, P, "en", "a"),
    (6, "another text under the same id " * 3, "en", "a"),
    (None, P + " null id", "en", None),
    (None, None, None, "c"),
    (7, "ÄÖÜ ß ﬁne éa é \U0001f600 " * 40 + P, "de", "é"),
    (8, "word " * 30000 + P, "en", "a"),
    (9, "Released under the MIT License. SPDX-License-Identifier: (GPL-3.0-only WITH x OR MIT) AND Apache-2.0\n$$$ ### |||", "en", "z"),
    (10, "one two", "en", "z"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    rows = [(i, t, lang, s, None if i == 3 else 1, "k", 1, None, 7, 5, None) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(duck):
    return {i: t or "" for i, t in duck.sql("select doc_id, text from documents").fetchall()}
