"""What several operators share: tables, checkpoints, word patterns, connected components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as characters.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id inside an operator; smaller than every other id.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike lower()."""
    return F.translate(text, UPPER, LOWER)


#: Thin rows of a partition, and rows with texts.
THIN, WIDE = 50_000, 5_000


def packed(df: DataFrame, rows: int, per: int = THIN) -> DataFrame:
    """``df`` in a partition for each ``per`` of its about ``rows`` rows, if it has more partitions: a small table costs few tasks and files."""
    return df.coalesce(max(1, -(-rows // per)))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the checkpoint folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, one under the warehouse if all runs
    on one machine, else an error: executors elsewhere don't see the driver's folders.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return df.checkpoint(eager=True)


def resized(df: DataFrame) -> DataFrame:
    """A thin checkpointed ``df`` without the size that Spark estimated for it, which a loop of joins would carry on.

    A checkpoint keeps the estimate of the plan behind it, and a join's is the product of its sides: with several joins
    a round its digits multiply each round, until the numbers fill the driver.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles, broadcasts and checkpoints of finished steps.

    Its cleaner follows the driver's garbage collections, which may not come before a long chain of jobs has ended.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, computed once, to be broadcast if it has at most ``most_rows`` rows and joined by a shuffle otherwise."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most_rows else df


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): root is the smallest node reachable over ``edges`` (a, b); nodes without an edge are absent.
    ``rows``: about how many nodes there are, if known, for a few files in place of many small ones.

    Alternates large-star and small-star steps until the edges stay as they are. A step is one
    aggregation with map-side combine, cut, and one join: both its sides then come from plain shuffles, so
    that Spark can split a hub's edges among tasks.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(packed(e, rows) if rows else e)
    seen = _mark(e)
    while seen[0]:
        n = seen[0]
        e = packed(e, n)
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = cut(packed(least, n))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(packed(packed(large.where("a <> b"), n).distinct(), n))
        low = cut(packed(large.groupBy("a").agg(F.min("b").alias("m")), n))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("p"))
        small = small.select(F.col("p.b").alias("a"), F.col("p.m").alias("b")).where("a <> b")
        e = resized(cut(packed(packed(small, n).distinct(), n)))
        now = _mark(e)
        release(e.sparkSession)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
    return (r[0], r[1], r[2])
