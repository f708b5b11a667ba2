"""The corpus pipeline: five stages from raw documents to token ids, each calling an operator of mailgauge.llm.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept; all but the last return the
columns of documents. ORACLE_SQL is None: the classifier, SimHash and BPE can't be expressed in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm import bpe, line_dedup, mixing, quality_classifier, simhash
from mailgauge.llm.common import cut, packed, small, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of these documents, doesn't reject."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score_documents(docs.select(COLUMNS), model).where("predicted = 1").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; one of which no line is left, or only blank ones, goes."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS)).withColumn("text", F.col("kept_text"))
    out = out.where("n_dropped = 0 or text rlike '[^ \\\\t-\\\\r]'")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near-duplicates."""
    return simhash.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to twice.

    A row is told by a digest of all its columns, so rows of one id, or without one, keep their own number of copies.
    Of rows that agree in all columns each gets the whole part of their copies' mean; what is left goes to one of them.
    Null texts have no words and aren't taken. An empty table gives an empty result; other columns are dropped.
    """
    told = [*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]]
    docs = docs.select(COLUMNS).withColumn("row", F.concat(F.hex(F.xxhash64(*told)), F.lit("-"), F.hex(F.xxhash64(F.lit(4), *told))))
    taken = mixing.mix(docs, row=F.col("row")).groupBy("row").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).where("copies > 0")
    taken = cut(packed(taken, docs.count()))
    times = lambda n: F.explode(F.sequence(F.lit(1), F.expr(n))).alias("time")
    each = docs.join(taken.where("copies >= n"), "row").select(*COLUMNS, times("copies div n"))
    left = docs.join(small(taken.where("copies % n > 0"), 10_000), "row").select(*COLUMNS, "n", "copies").distinct().select(*COLUMNS, times("copies % n"))
    return each.unionByName(left).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number and a digest of the text that they decode to."""
    out = bpe.encode_documents(docs.select(COLUMNS), *bpe.public_vocabulary(), ("ids", "n_tokens", "decoded_sha256"))
    return out.select("doc_id", "source", "bpe.*")


STAGES = [("quality_classifier", classify), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("source_mixing", mix_sources), ("byte_bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents; each one's rows are computed once, as later stages read them several times."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
