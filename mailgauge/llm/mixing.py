"""Operator 4: mix sources to target weights by weighted fair queueing, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailgauge.llm.common import WORD, cut, packed, table

#: Ranges of virtual finish time, in which the cut is searched.
RANGES = 65536
#: Source rows stand in this many hash buckets, by the first three hex digits of the hash.
BUCKET_DIGITS = 3
_ALL_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO_HERE = (Window.unboundedPreceding, 0)


def source_targets(sized: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(source, source_size, target), a row a source, of rows (source, size).

    Sources by code point, null last, weigh ``weights``, repeating, and share ``percent`` % of all sizes.
    A target stops at ``most`` times its source's size and the excess is reshared by weight. The reshare
    ends at one level of target over weight: in order of cap over weight, the first level that is not
    above the next source's cap.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights))
    by = by.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by = by.withColumn("full_at", F.col("cap") / F.col("weight"))
    lower, every = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(*_ALL_BEFORE), Window.partitionBy()
    left = F.sum("source_size").over(every) * (percent / 100.0) - F.coalesce(F.sum("cap").over(lower), F.lit(0.0))
    by = by.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0))))
    found = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"]
    return by.withColumn("found", found).select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("found"), "cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, row: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of (doc_id, source, text), and ``row`` if given.

    ``row``: what tells rows of one id apart, such as a digest; a caller finds each row's copies by it.

    Each source's documents are shuffled by the MD5 of their id. A document's virtual finish time is the
    source's words up to and with it over the source's target; a second pass over the source follows the
    first. The documents of all passes stand in order of finish time and are cut off before the one with
    which the total would pass the sum of the targets. Sums run in two levels, over hash buckets of each
    source and over ranges of finish time, so neither a hot source nor the table meets in one task. Only
    ids, sources and sizes are shuffled.

    Null text: size 0. Null source: a source of its own, last. Null ids: the MD5 of the text stands for the
    id, so rows without an id are shuffled too. Rows that agree in id, source, size and ``row`` are alike; any
    of them may be the one taken once more. Very long texts are only counted, in their own row. A source
    without words has target 0. Extra columns don't matter. An empty table gives an empty result.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    no_id = F.concat(F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), no_id)))
    told = [] if row is None else ["row"]
    sized = cut(docs.select("doc_id", "source", words.alias("size"), key.alias("key"), *([] if row is None else [row.alias("row")])))
    targets = source_targets(sized, weights, percent, most)
    one = sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = one.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(*_ALL_BEFORE)), F.lit(0)))
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *told).rowsBetween(*_UP_TO_HERE)
    a, b, t = one.withColumn("in_bucket", F.sum("size").over(inner)).alias("a"), sums.alias("b"), targets.alias("t")
    placed = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket")))
    placed = placed.join(t, F.col("a.source").eqNullSafe(F.col("t.source")))
    placed = cut(packed(placed.select("a.doc_id", "a.source", "size", "source_size", "target", (F.col("in_bucket") + F.col("before")).alias("upto"), "key", *told), sized.count()))
    real = (F.col("size") > 0) & (F.col("target") > 0)
    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass")
    items = placed.where(real).select("*", passes).withColumn("range", _range(F.col("pass")))
    per = items.groupBy("range").agg(F.sum("size").alias("s"))
    per = per.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(*_ALL_BEFORE)), F.lit(0)))
    budget = targets.agg(F.round(F.sum("target")).cast("long")).first()[0] or 0
    over = per.where(F.col("before") + F.col("s") > budget).orderBy("range").first()
    taken = F.lit(most)
    if over:
        inside = items.where(F.col("range") == over["range"]).withColumn("at", _place(F.col("pass")))
        inside = inside.withColumn("run", F.sum("size").over(Window.orderBy("at").rowsBetween(*_UP_TO_HERE)) + over["before"])
        end = inside.where(F.col("run") <= budget).agg(F.max("at").alias("at")).first()["at"]
        within = lambda c: (_place(c) <= F.struct(*[F.lit(x) for x in end]).cast("struct<f:double,key:string,i:bigint,s:string,size:bigint,c:int>")) if end else F.lit(False)
        early = lambda c: (_range(c) < over["range"]) | ((_range(c) == over["range"]) & within(c))
        taken = sum(F.when(early(F.lit(c)), 1).otherwise(0) for c in range(most))
    out = placed.withColumn("copies", F.when(real, taken).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *told)


def _finish(copy: Column) -> Column:
    return (copy * F.col("source_size") + F.col("upto")) / F.col("target")


def _range(copy: Column) -> Column:
    return F.least(F.floor(_finish(copy) * (RANGES // 4)), F.lit(RANGES))


def _place(copy: Column) -> Column:
    """Order of documents of all passes; by hash, id, source, size and pass where finish times tie."""
    return F.struct(_finish(copy).alias("f"), F.col("key"), F.coalesce("doc_id", F.lit(-1)).alias("i"), F.coalesce("source", F.lit("")).alias("s"), F.col("size"), copy.alias("c"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, ':' || md5(coalesce(text, '')))) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         (2 * source_size)::DOUBLE AS cap FROM s
), v AS (
  SELECT *, cap / weight AS full_at,
         ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER lower_ones, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER lower_ones, 0)) AS level
  FROM w WINDOW lower_ones AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, full_at) FROM v WHERE level <= full_at)) AS target FROM v
), p AS (
  SELECT d.*, t.source_size, t.target,
         (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT *, (pass * source_size + upto)::DOUBLE / target AS finish FROM p, (VALUES (0), (1)) x(pass) WHERE size > 0 AND target > 0
), r AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, key, doc_id, source, size, pass ROWS UNBOUNDED PRECEDING) AS run FROM i
), k AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM r WHERE run <= (SELECT round(sum(target)) FROM t) GROUP BY doc_id
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(k.taken, 0)::BIGINT AS taken FROM p LEFT JOIN k USING (doc_id)
"""
