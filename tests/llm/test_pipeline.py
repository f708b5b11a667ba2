"""The pipeline's stages: columns, what goes and what stays."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from mailgauge.llm.common import WORD


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, small).cache()
        if k < len(cp.STAGES) - 1:
            assert docs.columns == cp.COLUMNS, name
        if name != "source_mixing":
            assert docs.count() <= before
        before = docs.count()
    assert before > 0 and {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


def test_mixed_documents_follow_the_mix(spark, small):
    from mailgauge.llm import mixing

    docs = spark.read.parquet(f"{small}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in cp.mix_sources(spark, docs, small).groupBy("doc_id").count().collect()}
    assert got == copies


@pytest.mark.parametrize("ids", ["cast(null as bigint)", "doc_id % 3", "doc_id"])
def test_mix_returns_the_words_it_takes_with_null_shared_and_repeated_ids(spark, small, ids):
    from mailgauge.llm import mixing

    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr(f"{ids} as doc_id", "text", "lang", "source", "n_chars")
    docs = docs.union(docs.where("n_chars % 3 = 0"))
    taken = mixing.mix(docs).selectExpr("sum(taken)").first()[0]
    got = cp.mix_sources(spark, docs, small).select("*", F.regexp_count("text", F.lit(WORD)).alias("w"))
    assert got.agg(F.sum("w")).first()[0] == taken > 0
    there = Counter(tuple(r) for r in docs.collect())
    assert all(n <= 2 * there[k] for k, n in Counter(tuple(r)[:-1] for r in got.collect()).items())


@pytest.mark.parametrize("name", ["line_dedup", "near_dedup", "source_mixing", "byte_bpe"])
def test_stages_take_odd_and_empty_tables(spark, odd, empty, small, name):
    stage = dict(cp.STAGES)[name]
    assert stage(spark, odd, small).count() > 0 and stage(spark, empty, small).count() == 0


def test_run(spark, small):
    assert cp.run(spark, small).count() > 0


def test_each_stage_equals_brute_force(spark, small, tmp_path):
    """Each stage on what its predecessor kept, as Parquet, against its contract worked out row by row."""
    import hashlib
    import re

    import duckdb
    import public_tokenizers
    import tiktoken
    from test_operators import ASCII, group_roots

    from mailgauge.llm import bpe, mixing, quality_classifier, simhash

    kept, paths = [], [f"{small}/documents.parquet"]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, spark.read.parquet(paths[-1]), small).write.parquet(f"{tmp_path}/{k}")
        paths.append(f"{tmp_path}/{k}")
        kept.append([r.asDict() for r in spark.read.parquet(paths[-1]).collect()])
    before = [r.asDict() for r in spark.read.parquet(paths[0]).collect()]
    plain = lambda rows: sorted(tuple(r[c] for c in cp.COLUMNS) for r in rows)

    good = {r.doc_id for r in quality_classifier.op8_quality_classifier(spark, small).collect() if r.predicted == 1}
    assert plain(kept[0]) == plain(r for r in before if r["doc_id"] in good) and len(good) < len(before)

    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    holders = {}
    for r in kept[0]:
        for line in set(map(key, (r["text"] or "").split("\n"))):
            holders.setdefault(line, []).append(r["doc_id"])
    shared = {x for x, ids in holders.items() if len(x) >= 20 and len(ids) >= 3}
    want = []
    for r in kept[0]:
        lines = (r["text"] or "").split("\n")
        left = [x for x in lines if key(x) not in shared or max(holders[key(x)]) == r["doc_id"]]
        text = "\n".join(left)
        if len(left) == len(lines) or re.search(r"[^\x20\x09-\x0D]", text):
            want.append(r | {"text": text, "n_chars": len(text)})
    assert plain(kept[1]) == plain(want) and any(len(a) < len(b["text"]) for a, b in zip(sorted(r["text"] for r in kept[1]), kept[0]))

    shingles = {r["doc_id"]: set(simhash.shingle_hashes((r["text"] or "").encode(), 5).tolist()) for r in kept[1]}
    prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode(), 5) for r in kept[1]}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    roots = group_roots(sorted(shingles), near)
    assert plain(kept[2]) == plain(r for r in kept[1] if roots[r["doc_id"]] == r["doc_id"])

    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{paths[3]}/*.parquet'")
    copies = {i: taken // size for i, size, taken in duck.sql(f"select doc_id, size, taken from ({mixing.ORACLE}) where size > 0").fetchall()}
    assert plain(kept[3]) == plain(r for r in kept[2] for _ in range(copies.get(r["doc_id"], 0)))

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.NAME)), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = {r["text"]: encoding.encode_ordinary(r["text"]) for r in kept[3]}
    got = sorted((r["doc_id"], r["source"] or "", list(r["ids"]), r["n_tokens"], r["decoded_sha256"]) for r in kept[4])
    assert got == sorted((r["doc_id"], r["source"] or "", ids[r["text"]], len(ids[r["text"]]), sha(r["text"].encode())) for r in kept[3])
