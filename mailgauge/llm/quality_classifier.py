"""Operator 8: quality classifier, a linear support vector model on naive Bayes features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailgauge.llm.common import table

#: Hash buckets of byte n-grams; behind them stand those of the word pattern n-grams.
BITS, PATTERNS = 18, 1024
SIZE = (1 << BITS) + PATTERNS
#: Labels that the bucket counts are taken from, those of the smallest hash: the bound of what is broadcast, 16 bytes each.
LABELS = 200_000
#: Rows of each class, and about the bytes of their texts, that the support vector model is fitted on.
SAMPLE, SAMPLE_BYTES = 3000, 8 << 20


def features(data: bytes, seen: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams in a text, each once: its byte 4-grams, hashed, and its word pattern 5-grams.

    A word's pattern is two bits: whether it equals the word before, and the one before that. ``seen`` is a
    zeroed boolean work array of SIZE, and is zero again afterwards.
    """
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) >= 4:
        grams = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
        seen[(grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    words = np.fromiter(map(hash, data.split()), np.int64)
    if len(words):
        bits = np.zeros(len(words) + 4, np.int64)
        bits[5:] |= words[1:] == words[:-1]
        bits[6:] |= (words[2:] == words[:-2]) << 1
        codes = bits[4:] | bits[3:-1] << 2 | bits[2:-2] << 4 | bits[1:-3] << 6 | bits[:-4] << 8
        seen[(1 << BITS) + codes] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


class Model:
    """``ratio``: log-count ratio of each bucket; ``weight``: the support vector's; score: sigmoid(a * margin + b)."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, a: float, b: float):
        self.ratio, self.weight, self.a, self.b = ratio.astype(np.float32), weight.astype(np.float32), a, b

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found].astype(np.float64)
        norm = np.sqrt(r @ r)
        return float(r @ self.weight[found] / norm) if norm else 0.0

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(found) + self.b, -30, 30))))


def log_count_ratio(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    p, q = good + 1.0, bad + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 12, seed: int = 8) -> np.ndarray:
    """The weights that minimise |w|^2 / 2 + sum of cost * hinge loss, over sparse rows (indices, values)."""
    w, alpha, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([v @ v for _, v in rows])
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            if not square[i]:
                continue
            new = min(max(alpha[i] - (y[i] * (w[at] @ v) - 1) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


def platt(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a * margin + b), by Newton steps on the weighted log loss with a small ridge."""
    x, t, ab = np.stack([margin, np.ones_like(margin)]), good.astype(float), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        g = x @ (weight * (p - t)) + 1e-2 * ab
        h = (x * (weight * p * (1 - p))) @ x.T + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        ab = ab - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_labels: int = LABELS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model of labels' column quality from the rows of (doc_id, text) that have a label and aren't held out.

    Bucket counts of each class come from the rows of at most ``most_labels`` labels; the support vector model from
    at most ``sample`` rows of each class, of about ``sample_bytes`` of text, three quarters of them, and the sigmoid from the
    other quarter, weighted to the classes' shares. Both samples are those of the smallest hash, so that reruns agree.
    Repeated labels of one document: the smallest counts. None if a class has no rows.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    known = F.broadcast(known.orderBy(order, "doc_id").limit(most_labels))
    rows = docs.select("doc_id", _bytes(F.col("text")).alias("data")).join(known, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, total = np.zeros(SIZE, bool), np.zeros((2, SIZE), np.int64), [0, 0]
        for b in batches:
            for data, q in zip(b["data"].to_pylist(), b["quality"].to_pylist(), strict=True):
                n[q][features(data, seen)] += 1
                total[q] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), pa.array([*n[1][at], total[1]], pa.int64()), pa.array([*n[0][at], total[0]], pa.int64())], names=["bucket", "good", "bad"])

    got = rows.select("data", "quality").mapInArrow(count, "bucket long, good long, bad long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    n = np.zeros((2, SIZE + 1), np.int64)
    at = got["bucket"].to_numpy()
    n[1][at], n[0][at] = got["good"].to_numpy(), got["bad"].to_numpy()
    total, n = n[:, -1], n[:, :-1]
    if not total.all():
        return None
    ratio = log_count_ratio(n[1].astype(float), n[0].astype(float))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE, bool)
        for b in batches:
            found = [features(d, seen).astype(np.int32) for d in b["data"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["quality"], pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "quality", "found"])

    # Drawn after the join, so that documents which share an id, or are very long, don't add to what the driver gets.
    thin = rows.select("doc_id", "quality", F.xxhash64("data").alias("h"), F.length("data").cast("long").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("quality").orderBy(order, "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1))
    drawn = [thin.where(F.col("quality") == q).orderBy(order, "doc_id", "h").limit(sample) for q in (0, 1)]
    picked = drawn[0].unionAll(drawn[1]).withColumn("upto", upto).where(F.coalesce("upto", F.lit(0)) < sample_bytes).select("doc_id", "h").distinct()
    chosen = rows.withColumn("h", F.xxhash64("data")).join(F.broadcast(picked), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    got = chosen.select("doc_id", "quality", "data").mapInArrow(find, "doc_id long, quality int, found array<int>").toArrow().sort_by([("doc_id", "ascending")])
    ids, y01 = got["doc_id"].to_numpy(), got["quality"].to_numpy()
    cells = [np.asarray(x) for x in got["found"].combine_chunks().to_numpy(zero_copy_only=False)]
    first = np.lexsort(([len(x) for x in cells], ids * 2654435761 % 2**31, ids))
    vectors = []
    for i in first:
        v = ratio[cells[i]]
        vectors.append((cells[i], (v / max(1e-12, np.sqrt(v @ v))).astype(np.float32)))
    good = y01[first] == 1
    fold = np.arange(len(first)) % 4 == 3
    train = np.flatnonzero(~fold)
    share = np.array([total[0] / max(1, (~good).sum()), total[1] / max(1, good.sum())]) / total.sum() * len(good)
    cost = 1.0 * np.ones(len(train))
    w = dual_coordinate_descent([vectors[i] for i in train], np.where(good[train], 1.0, -1.0), cost, SIZE)
    test = np.flatnonzero(fold) if len(set(good[fold])) == 2 else np.arange(len(first))
    margins = np.array([w[vectors[i][0]] @ vectors[i][1] for i in test])
    a, b = platt(margins, good[test], np.where(good[test], share[1], share[0]))
    return Model(ratio, w, a, b)


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` plus score, 0 to 1, and predicted, 1 from a score of 0.5 on, by column text alone.

    Null or empty text: the score of no n-grams. Without a model every score is 0.5. Row by row; the model
    is two arrays of SIZE floats. Repeated rows score alike; columns ``score`` and ``predicted`` of the input are
    replaced, other columns pass through. An empty table gives an empty result.
    """
    if model is None:
        return docs.withColumns({"score": F.lit(0.5), "predicted": F.lit(1)})

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = np.zeros(SIZE, bool)
        for texts in batches:
            yield pa.array([model.score(features(d.as_py() or b"", seen)) for d in texts], pa.float64())

    out = docs.withColumn("score", F.arrow_udf(run, "double")(_bytes(F.col("text"))))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
