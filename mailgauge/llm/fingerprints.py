"""Operator 5: canonical exact fingerprints of documents, natively."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailgauge.llm.common import NO_ID, cut, small, table

#: Rows of one range of ids, and the most ranges there are; with more rows the ranges grow.
RANGE_ROWS, MOST_RANGES = 256, 65536
#: Digests of up to this many buckets, under 100 bytes each, are broadcast; more are joined by a shuffle.
MOST_BUCKETS = 200_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, then runs of white space to one blank, none at the ends.

    Both Unicode steps are static methods of the ICU library that ships with Spark, called in the JVM.
    """
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.btrim(F.regexp_replace(compose(folded), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of two XXH64 of different seeds, as 32 hex digits."""
    part = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit(5), canon)))


def likeness(fp: Column, other: Column, canon: Column, other_canon: Column) -> Column:
    """1 if the digests are equal and the canonical bytes behind them too, else 0; null if there is no other."""
    return F.when(other.isNull(), F.lit(None)).when((fp == other) & (canon == other_canon), 1.0).otherwise(0.0)


def _short(canon: Column, bits: int) -> Column:
    return F.substring(digest(canon), 1, bits // 4)


def unequal_buckets(docs: DataFrame, bits: int = 128) -> DataFrame:
    """(bucket): the digests under which (doc_id, text) has different canonical bytes, as good as never any.

    Of a digest that several rows have the smallest and the largest canonical text are compared byte by byte; they are
    found with map-side combine, so copies meet as one row a task, and the texts of single rows aren't shuffled.
    """
    own = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    again = small(own.groupBy(_short(canonical(F.col("text")), bits).alias("bucket")).agg(F.count("*").alias("n")).where("n > 1").select("bucket"), MOST_BUCKETS)
    met = own.withColumn("bucket", _short(canonical(F.col("text")), bits)).join(again, "bucket")
    both = met.select("bucket", canonical(F.col("text")).alias("canon")).groupBy("bucket").agg(F.min("canon").alias("a"), F.max("canon").alias("b"))
    return small(both.where("a <> b").select("bucket"), MOST_BUCKETS)


def with_fingerprint(df: DataFrame, text: str, into: str, unequal: DataFrame, bits: int = 128) -> DataFrame:
    """``df`` plus ``into``: the digest of a text column, and behind it the SHA-256 of the canonical text where the bucket is unequal."""
    canon = canonical(F.col(text))
    df = df.withColumn(into, _short(canon, bits))
    marked = df.join(unequal.select(F.col("bucket").alias("__bucket")), F.col(into) == F.col("__bucket"), "left")
    return marked.withColumn(into, F.when(F.col("__bucket").isNull(), F.col(into)).otherwise(F.concat(into, F.sha2(canon, 256)))).drop("__bucket")


def group_ids(prints: DataFrame) -> DataFrame:
    """(fingerprint, group_id) of rows (doc_id, fingerprint): the smallest id that has it; counted once, so that joins on hot ones can be split."""
    return cut(prints.groupBy("fingerprint").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("group_id")))


def groups(docs: DataFrame, fp_bits: int = 128) -> DataFrame:
    """(doc_id, fingerprint, group_id): documents of equal canonical text share the smallest doc_id of theirs.

    Documents are grouped by digest; inside a digest that more than one document has, canonical bytes are
    compared, and where they differ told apart by SHA-256. Null text counts as empty, a null id as the
    smallest. ``fp_bits`` below 128 shortens digests, for tests. An empty table gives an empty result.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prints = with_fingerprint(own, "text", "fingerprint", unequal_buckets(own, fp_bits), fp_bits).select("doc_id", "fingerprint")
    return prints.join(group_ids(prints), "fingerprint").select("doc_id", "fingerprint", F.nullif("group_id", F.lit(NO_ID)).alias("group_id"))


def with_next(docs: DataFrame, cols: list[str], id_col: str = "doc_id") -> DataFrame:
    """``docs`` plus next_<col> of the row that follows by id, then by text; after the last comes the first.

    Rows are dealt into ranges of ids of about equal count (quantiles, at most MOST_RANGES numbers on the
    driver) and ordered within; the last row of a range takes the first of the following one, by a join
    with a row a range.
    """
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    place = F.coalesce(F.col(id_col), F.lit(NO_ID))
    docs = docs.withColumn("__place", place).withColumn("__at", place.cast("double"))
    splits = sorted(set(docs.approxQuantile("__at", [i / ranges for i in range(1, ranges)], max(0.2 / ranges, 2e-5)))) if ranges > 1 else []
    if splits:
        docs = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="__at", outputCol="__range").transform(docs)
    else:
        docs = docs.withColumn("__range", F.lit(0.0))
    order = Window.partitionBy("__range").orderBy("__place", *[c for c in cols if c == "text"])
    led = docs.withColumn("__next", F.lead(F.struct(*cols)).over(order))
    # The first row of each range goes to the last of the range before.
    firsts = docs.groupBy("__range").agg(F.min("__place").alias("__place"))
    firsts = docs.join(F.broadcast(firsts), ["__range", "__place"]).groupBy("__range").agg(F.min(F.struct(*cols)).alias("__first"))
    back = Window.orderBy("__range")
    previous = F.coalesce(F.lag("__range").over(back), F.max("__range").over(Window.partitionBy()))
    # One task numbers the ranges, without their texts.
    before = firsts.select("__range").select("__range", previous.alias("__before"))
    firsts = firsts.join(before, "__range").select(F.col("__before").alias("__range"), "__first")
    led = led.join(firsts, "__range", "left").withColumn("__next", F.coalesce("__next", "__first"))
    return led.select(*[c for c in docs.columns if not c.startswith("__")], *[F.col("__next")[c].alias(f"next_{c}") for c in cols])


def compare(docs: DataFrame) -> DataFrame:
    """What op5 returns, plus group_id, of (doc_id, text); see groups for fingerprints and groups, with_next for the order.

    Null text counts as empty; equal texts have equal fingerprints. Rows of one id are ordered by text. A
    null id comes first. A table of one row is followed by itself. Extra columns aren't returned.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    unequal = unequal_buckets(own)
    both = with_next(with_fingerprint(own, "text", "fingerprint", unequal), ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    both = with_fingerprint(both, "edited", "edited_fingerprint", unequal)
    near = lambda fp, text: likeness(F.col("fingerprint"), F.col(fp), canonical(F.col("text")), canonical(F.col(text)))
    out = both.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited_fingerprint", "edited").alias("near_edited"), near("next_fingerprint", "next_text").alias("near_next"))
    named = group_ids(with_fingerprint(own, "text", "fingerprint", unequal))
    return out.join(named, "fingerprint").select(*out.columns, F.nullif("group_id", F.lit(NO_ID)).alias("group_id"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
