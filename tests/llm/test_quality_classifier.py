"""Operator 8 over a whole table against features by definition and another solver."""

import zlib

import numpy as np

from mailgauge.llm import quality_classifier as qc


def plain_features(text):
    """Buckets of 4-byte strings and of equality patterns of the last words, by dictionaries."""
    data = text.encode()
    found = {(int.from_bytes(data[i : i + 4], "little") * 2654435761 % 2**32) >> (32 - qc.BITS) for i in range(len(data) - 3)}
    words = data.split()
    near = lambda i: (int(i >= 1 and words[i] == words[i - 1]) | int(i >= 2 and words[i] == words[i - 2]) << 1) if i >= 0 else 0
    for i in range(len(words)):
        found.add((1 << qc.BITS) + sum(near(i - k) << 2 * k for k in range(5)))
    return np.array(sorted(found), np.int64)


def best_objective(x, y):
    """The least |w|^2 / 2 + sum of hinge losses, by projected ascent on the dual with the whole Gram matrix."""
    q = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(len(y)), 1.0 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0.0, 1.0)
    return objective(x.T @ (alpha * y), x, y)


def objective(w, x, y):
    return w @ w / 2 + np.maximum(0.0, 1 - y * (x @ w)).sum()


def test_whole_table_against_another_solver(spark, small, texts, duck):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = qc.fit(docs, labels)
    known = dict(duck.sql("select doc_id, quality from labels where quality is not null").fetchall())
    learnt = sorted(i for i in known if i in texts and zlib.crc32(str(i).encode()) % 3 != 1)
    found = {i: plain_features(t) for i, t in texts.items()}
    n = np.zeros((2, qc.SIZE))
    for i in learnt:
        n[known[i]][found[i]] += 1
    ratio = np.log((n[1] + 1) / (n[1] + 1).sum()) - np.log((n[0] + 1) / (n[0] + 1).sum())
    assert np.allclose(model.ratio, ratio, atol=1e-5)

    train = [i for k, i in enumerate(learnt) if k % 4 != 3]
    used = np.unique(np.concatenate([found[i] for i in train]))
    x = np.zeros((len(train), len(used)))
    for row, i in enumerate(train):
        v = ratio[found[i]]
        x[row, np.searchsorted(used, found[i])] = v / max(1e-12, np.sqrt(v @ v))
    y = np.array([1.0 if known[i] else -1.0 for i in train])
    least, got = best_objective(x, y), objective(model.weight[used].astype(float), x, y)
    assert least <= got * (1 + 1e-6) and got <= least * 1.02 and not np.delete(model.weight, used).any()

    rows = {r.doc_id: r for r in qc.op8_quality_classifier(spark, small).collect()}
    assert set(rows) == set(texts)
    right = []
    for i, r in rows.items():
        v = ratio[found[i]]
        norm = np.sqrt(v @ v)
        margin = v @ model.weight[found[i]] / norm if norm else 0.0
        assert abs(r.score - 1 / (1 + np.exp(-(model.a * margin + model.b)))) < 1e-4, i
        assert r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        if r.held_out and i in known:
            right.append(r.predicted == known[i])
    assert len(right) >= 5 and np.mean(right) >= 0.9
