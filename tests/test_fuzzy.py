"""Ratios against the standard library's, candidates against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from mailgauge.operators import fuzzy


def drawn(seed, n, alphabet, most):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize(("alphabet", "most"), [("ab", 12), ("abcdefgh", 16), ("aé€😀 ", 9)])
def test_ratio(spark, alphabet, most):
    pairs = list(zip(drawn(1, 200, alphabet, most), drawn(2, 200, alphabet, most)))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", fuzzy.block_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        assert abs(r.r - difflib.SequenceMatcher(None, *pairs[r.i], autojunk=False).ratio()) < 1e-12, pairs[r.i]


@pytest.mark.parametrize("cutoff", [0.4, 0.6, 0.85, 1.0])
def test_matches_equal_all_pairs(spark, cutoff):
    names, words = drawn(3, 80, "abcdef", 10) + ["appel", "paypa1", None, ""], drawn(4, 60, "abcdef", 10) + ["ape", "apple", "peach", "puppy", "paypal", None, ""]
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string").repartition(3)
    got = {}
    for r in fuzzy.close_matches(frame(names, "name"), frame(words, "word"), cutoff, 3).orderBy("name", "place").collect():
        got.setdefault(r.name, []).append(r.match)
    known = sorted({w for w in words if w})
    want = {n: difflib.get_close_matches(n, known, 3, cutoff) for n in {n for n in names if n}}
    assert got == {n: m for n, m in want.items() if m}
    one = {r.name: r.match for r in fuzzy.close_matches(frame(names, "name"), frame(words, "word"), cutoff).collect()}
    assert one == {n: m[0] for n, m in got.items()}


def test_candidates_are_few_and_whole(spark):
    names, words = {n for n in drawn(5, 400, "abcdefghijklmnop", 14) if n}, {w for w in drawn(6, 300, "abcdefghijklmnop", 14) if w}
    pairs = fuzzy.candidates(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(w,) for w in words], "word string"), 0.7)
    got = {tuple(p) for p in pairs.collect()}
    near = {(n, w) for n in names for w in words if difflib.SequenceMatcher(None, w, n, autojunk=False).ratio() >= 0.7}
    assert near <= got and len(got) < 0.05 * len(names) * len(words)
