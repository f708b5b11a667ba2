"""Fuzzy matching of names against a table of words: ratio of matching blocks, candidates from an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgauge.functions.text import bind


def _longest(a: Column, b: Column) -> Column:
    """The longest text that two texts share, the first such in a and there the first in b: struct of places i, j and length n; null without any."""
    shorter = F.least(F.length(a), F.length(b))
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.length(a) - n + 1), lambda i: F.struct(i.alias("i"), F.position(a.substr(i, n), b).alias("j"), n.alias("n")))
    every = F.flatten(F.transform(F.sequence(shorter, F.lit(1), F.lit(-1)), of_length))
    return F.when(shorter > 0, F.get(F.filter(every, lambda x: x["j"] > 0), F.lit(0)))


def block_ratio(a: Column, b: Column) -> Column:
    """Ratcliff and Obershelp's ratio: twice the characters in matching blocks over those of both texts, 1 for two empty ones.

    The longest block that both share, then the same left and right of it: a fold over lists of pairs of texts that
    still may share something. No character counts as junk, however long the texts are. Null: null.
    """
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))

    def split(p: Column) -> Column:
        def parts(m: Column) -> Column:
            left = pair(p["a"].substr(F.lit(1), m["i"] - 1), p["b"].substr(F.lit(1), m["j"] - 1))
            right = pair(p["a"].substr(m["i"] + m["n"], F.length(p["a"])), p["b"].substr(m["j"] + m["n"], F.length(p["b"])))
            return F.struct(F.coalesce(m["n"], F.lit(0)).alias("n"), F.when(m.isNotNull(), F.filter(F.array(left, right), lambda x: (x["a"] != "") & (x["b"] != ""))).otherwise(F.array().cast("array<struct<a:string,b:string>>")).alias("rest"))

        return bind(_longest(p["a"], p["b"]), parts)

    def step(s: Column, _: Column) -> Column:
        out = lambda d: F.struct((s["n"] + F.aggregate(d, F.lit(0), lambda x, y: x + y["n"])).alias("n"), F.flatten(F.transform(d, lambda y: y["rest"])).alias("left"))
        return F.when(F.size(s["left"]) == 0, s).otherwise(bind(F.transform(s["left"], split), out))

    zero = F.struct(F.lit(0).alias("n"), F.array(pair(a, b)).alias("left"))
    rounds = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.aggregate(rounds, zero, step)["n"] / total)


def _signs(text: Column) -> Column:
    """A text's characters, each with how often it stood there before: what two texts share of these bounds their blocks."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return bind(chars, lambda cs: F.transform(cs, lambda c, i: F.concat(c, F.size(F.filter(F.slice(cs, 1, i + 1), lambda x: x == c)).cast("string"))))


def candidates(names: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """The pairs of different ``names`` (name) and ``known`` (word) that may have a ratio of ``cutoff`` or more; none of these is missing.

    A ratio of c takes c / 2 of all characters in common, so at least c / (2 - c) of either text's own. Two texts that
    share so many signs share one of the first few in an order of all signs, the rarest among the words first: only those
    few stand in the index, which both sides join by sign.
    """
    least = lambda n: F.ceil(n * (cutoff / (2 - cutoff)) - 1e-9)

    def indexed(df: DataFrame, col: str, rank: DataFrame) -> DataFrame:
        signs = df.select(F.col(col), F.length(col).alias("n"), F.explode(_signs(F.col(col))).alias("sign")).join(rank, "sign", "left")
        ordered = signs.groupBy(col, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(0)).alias("r"), "sign"))).alias("s"))
        return ordered.select(col, "n", F.col("s.sign").alias("signs"), F.explode(F.slice(F.col("s.sign"), F.lit(1), (F.col("n") - least(F.col("n")) + 1).cast("int"))).alias("sign"))

    names, known = names.select("name").where("name <> ''").distinct(), known.select("word").where("word <> ''").distinct()
    rank = known.select(F.explode(_signs(F.col("word"))).alias("sign")).groupBy("sign").agg(F.count("*").alias("rank"))
    a, b = indexed(names, "name", rank).withColumnsRenamed({"n": "m", "signs": "of_name"}), indexed(known, "word", rank)
    near = a.join(b, "sign").where((F.col("n") >= F.col("m") * (cutoff / (2 - cutoff)) - 1e-9) & (F.col("m") >= F.col("n") * (cutoff / (2 - cutoff)) - 1e-9))
    shared = F.size(F.array_intersect("of_name", "signs"))
    return near.where(2 * shared >= cutoff * (F.col("m") + F.col("n")) - 1e-9).select("name", "word").distinct()


def close_matches(names: DataFrame, known: DataFrame, cutoff: float = 0.6, most: int = 1) -> DataFrame:
    """(name, place, match, ratio): for each different name its ``most`` words of the largest ratios of at least ``cutoff``, of ties the larger word.

    ``known`` is a table of words of any size. Null and empty names and words match nothing; names without a match are absent.
    """
    pairs = candidates(names, known, cutoff).select("name", F.col("word").alias("match"), block_ratio(F.col("word"), F.col("name")).alias("ratio")).where(F.col("ratio") >= cutoff)
    if most == 1:
        best = pairs.groupBy("name").agg(F.max(F.struct("ratio", "match")).alias("b"))
        return best.select("name", F.lit(1).alias("place"), "b.match", "b.ratio")
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ratio"), F.desc("match")))
    return pairs.withColumn("place", place).where(F.col("place") <= most).select("name", "place", "match", "ratio")
