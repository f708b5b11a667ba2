"""Operator 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from mailgauge.llm import resampling

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most=2):
    words = TOKEN.findall((text or "").translate(ASCII))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, x in docs:
        words, f = features(x)
        weight = math.floor(sum(gain(bucket(y)) for y in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_query_equals_brute_force(spark, small, texts, duck):
    got = resampling.op13_importance_resampling(spark, small)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    target = [x for (x,) in duck.sql("select text from benchmark").fetchall()]
    assert sorted(map(tuple, got.collect()), key=str) == brute(list(texts.items()), target)


def test_odd_rows(spark, odd, empty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    target = [(None,), ("",), ("The lazy dog, nobody knows",)]
    monkeypatch.setattr(resampling, "FEW", 1)
    got = sorted(map(tuple, resampling.resample(odd, spark.createDataFrame(target, "text string")).collect()), key=str)
    want = brute(rows, [t for (t,) in target])
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    for source, to in ((empty, odd), (empty, empty), (odd, empty)):
        assert resampling.resample(source, to).count() == source.count()
    assert resampling.resample(odd, odd, percent=100, min_words=0).where("rank is null").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_nth_largest(spark, monkeypatch, seed):
    """Ties in the first columns, whole ranges of 64 bits, any place of the key."""
    monkeypatch.setattr(resampling, "FEW", 3)
    r = random.Random(seed)
    ends = r.choice([(-5, 5), (0, 0), (-(2**63), 2**63 - 1), (10**6, 10**6 + 70_000)])
    rows = [(r.randint(*ends), r.choice([-(2**63), -1, 0, 2**63 - 1]), r.randint(-3, 3), i) for i in range(400)]
    keys = spark.createDataFrame(rows, "a long, b long, c long, d long").repartition(3).cache()
    for n in {1, 2, 57, 399, 400, r.randint(1, 400)}:
        assert resampling.nth_largest(keys, n) == sorted(rows, reverse=True)[n - 1]
    assert resampling.nth_largest(keys, 401) is None and resampling.nth_largest(keys, 0) is None
    same = spark.createDataFrame([(4, 4)] * 50, "a long, b long")
    assert resampling.nth_largest(same, 20) == (4, 4)


def test_equal_rows_are_drawn_one_by_one(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text)] * 40 + [(1, text)] * 40, "doc_id long, text string").repartition(5)
    got = resampling.resample(docs, docs.limit(1)).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 21)) and len(got) == 80


def test_rank_follows_score(spark):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(300)]
    docs = [(i, " ".join(r.choices(vocabulary[:100] if i % 2 else vocabulary[100:], k=25))) for i in range(600)]
    target = spark.createDataFrame([(" ".join(r.choices(vocabulary[:100], k=400)),)], "text string")
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), target).where("rank is not null").orderBy("rank").collect()
    assert [x["rank"] for x in got] == list(range(1, 151))
    assert [(-x.score, x.doc_id) for x in got] == sorted((-x.score, x.doc_id) for x in got)
    assert sum(x.doc_id % 2 for x in got) > 85  # half of all documents are odd


def test_long_text(spark):
    words = [f"w{i % 1000}" for i in range(300_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "é" * 500_000), (3, "-" * 500_000)], "doc_id long, text string")
    got = {x.doc_id: x.n_features for x in resampling.resample(docs, docs).collect()}
    assert got == {1: 599_999, 2: 1, 3: 0}
