"""Operator 13: importance resampling towards a target's distribution of hashed n-grams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm.common import ascii_lower, cut, table

#: One word: a run of letters, digits and anything beyond ASCII, in lower-cased text.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of a key that one round of the radix selection tells apart.
DIGIT = 12
#: Rows left at which the selection looks at keys instead of counting digits.
FEW = 10_000
_LOWEST = -(1 << 63)
#: Rows of a partition have consecutive numbers in these low bits of monotonically_increasing_id().
_ROW_BITS = 33


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def buckets(words: Column, most_words: int, n_buckets: int) -> Column:
    """The bucket of each run of 1 to ``most_words`` consecutive ``words``, repeats included; ``words`` should be a column, as it is read for each run."""
    bucket = lambda s: F.crc32(s.cast("binary")) % n_buckets

    def longer(n: int) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda k: bucket(F.concat_ws(" ", *[F.get(words, k + j) for j in range(n)])))
        return F.when(F.size(words) >= n, run).otherwise(F.array().cast("array<bigint>"))

    return F.concat(F.transform(words, bucket), *map(longer, range(2, most_words + 1)))


def bucket_counts(texts: DataFrame, most_words: int, n_buckets: int) -> dict[int, int]:
    """How many runs of words each bucket gets, over all rows of (text); one partial row a bucket and task is shuffled."""
    hashed = texts.select(tokens(F.col("text")).alias("w")).select(F.explode(buckets(F.col("w"), most_words, n_buckets)).alias("bucket"))
    return dict(hashed.groupBy("bucket").agg(F.count("*")).collect())


def gains(source: dict[int, int], target: dict[int, int], n_buckets: int) -> list[int]:
    """For each bucket floor(1000 ln) of its smoothed share of the target over that of the source."""
    s_all, t_all = (float(sum(c.values()) + n_buckets) for c in (source, target))
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all))) for b in range(n_buckets)]


def nth_largest(keys: DataFrame, n: int) -> tuple[int, ...] | None:
    """The ``n``-th largest row of ``keys``, whose long columns are compared one after another; None if there are fewer rows.

    Radix selection: a round counts the next DIGIT bits of the rows that begin like the key, from partial counts, and
    brings at most 2 ** DIGIT numbers to the driver. Bits that no row differs in are skipped. Rounds go on from column to
    column, so however many ties in one are told apart by the next, and end when few rows are left.
    """
    names = keys.columns
    ends = keys.agg(F.count("*"), *[f(c) for c in names for f in (F.min, F.max)]).first()
    if n < 1 or ends[0] < n:
        return None
    found, rest, left = [], keys, ends[0]
    for k, name in enumerate(names):
        low, high = ends[1 + 2 * k : 3 + 2 * k]
        near = high - low < -_LOWEST
        value = F.col(name) - F.lit(low) if near else F.col(name).bitwiseXOR(F.lit(_LOWEST))
        bits, prefix = (high - low).bit_length() if near else 64, 0
        while bits and left > FEW:
            step = min(DIGIT, bits)
            digit = F.shiftrightunsigned(value, bits - step).bitwiseAND(F.lit((1 << step) - 1))
            for d, rows in sorted(map(tuple, rest.groupBy(digit).agg(F.count("*")).collect()), reverse=True):
                if rows >= n:
                    break
                n -= rows
            rest, left, bits, prefix = rest.where(digit == d), rows, bits - step, prefix << step | d
        if left <= FEW:
            return sorted(map(tuple, rest.collect()), reverse=True)[n - 1]
        found.append(prefix + (low if near else _LOWEST))
    return tuple(found)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` plus ``rank``, 1 for the first in ``order``: sorted by ranges, ranked within them, the ranges' sizes added up."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("place", _ROW_BITS)
    before, offsets = 0, {}
    for p, n in sorted(map(tuple, placed.groupBy(part).agg(F.count("*")).collect())):
        offsets[p], before = before, before + n
    start = F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair]) if offsets else F.create_map().cast("map<bigint,bigint>")
    return placed.withColumn("rank", F.element_at(start, part) + F.col("place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).drop("place")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, most_words: int = 2, n_buckets: int = 10_000, min_words: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long, of each row of (doc_id, text); rank is null for rows that aren't drawn.

    A row's weight is the floored mean gain of its hashed runs of 1 to ``most_words`` words, its score the weight plus
    Gumbel noise of its id: the floor(``percent`` % of the rows with at least ``min_words`` words) highest scores
    are a sample without replacement by weight. The gains of ``n_buckets`` buckets are one array, a literal of the plan.
    Counts are over all rows of ``docs`` and of ``target`` (text). The last row drawn is found by radix selection on
    score and id; only drawn rows are sorted.

    Null or empty texts: no features, weight 0, not drawn. Ties go to the smaller id. Null ids: the noise of an empty id,
    behind all others; rows of one score and id go by a digest of their text, equal rows in any order. Very long
    texts: an array of the words and one of the buckets in their own row. Other columns are ignored. An empty table gives an
    empty result; an empty target has equal shares.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(texts, most_words, n_buckets), bucket_counts(target.select("text"), most_words, n_buckets), n_buckets)
    gain = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    hashed = texts.select("doc_id", F.xxhash64("text").alias("digest"), tokens(F.col("text")).alias("w"))
    hashed = hashed.select("doc_id", "digest", F.size("w").alias("words"), buckets(F.col("w"), most_words, n_buckets).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda a, b: a + F.get(gain, b.cast("int")))
    n = F.size("b").cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))
    scored = hashed.select("doc_id", "digest", "words", n.alias("n_features"), F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long").alias("weight"))
    scored = cut(scored.withColumns({"score": (F.col("weight") + noise).cast("long"), "row": F.monotonically_increasing_id()}))
    fit = F.col("words") >= min_words
    # ~id falls as the id grows, without overflow.
    key = [F.col("score"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-_LOWEST - 1))).alias("i"), F.col("digest"), F.col("row")]
    last = nth_largest(scored.where(fit).select(*key), scored.where(fit).count() * percent // 100)
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = fit & (F.struct(*[c.alias(f"c{k}") for k, c in enumerate(key)]) >= F.struct(*[F.lit(x).cast("long").alias(f"c{k}") for k, x in enumerate(last)]))
    rows = scored.withColumn("drawn", drawn)
    first = ranked(rows.where("drawn").withColumn("i", key[1]), [F.desc(c) for c in ("score", "i", "digest", "row")])
    return first.select(*out, "rank").unionByName(rows.where("not drawn").select(*out, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def _sql_words(name: str, ident: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {ident} AS id, regexp_extract_all({lower}, '{TOKEN}') AS w FROM {name}"


ORACLE = rf"""
WITH crc AS (
  SELECT list(list_reduce([i] || range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tbl FROM range(256) r(i)
), dw AS ({_sql_words("documents", "doc_id")}), bw AS ({_sql_words("benchmark", "NULL::BIGINT")}), runs AS (
  SELECT id, len(w) AS words, w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) AS f, false AS target FROM dw
  UNION ALL SELECT id, len(w), w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]), true FROM bw
), one AS (
  SELECT id, target, unnest(f) AS f FROM runs
), known AS (
  SELECT f, xor(list_reduce([4294967295] || list_transform(range(0, len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT),
            lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM one)), crc
), n AS (
  SELECT bucket, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM one JOIN known USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM n) + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))::DOUBLE))::BIGINT AS g FROM n
), w AS (
  SELECT id, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM one JOIN known USING (f) JOIN gain USING (bucket) WHERE NOT target GROUP BY id
), v AS (
  SELECT r.id AS doc_id, r.words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)
         + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || r.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, coalesce(weight, 0) AS weight
  FROM runs r LEFT JOIN w ON w.id = r.id WHERE NOT target
), k AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM v WHERE words >= 20
)
SELECT v.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM k) * 25 // 100 THEN rank END AS rank FROM v LEFT JOIN k USING (doc_id)
"""
