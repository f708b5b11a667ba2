"""Operator 7: quality rules by divergence from language references, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailgauge.llm.common import cut, small, table

#: Character classes counted by expression; blanks and symbols come from the base rules, the rest is one class.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r".,;:!?'\"()-"}
#: Words of a language's histogram.
COMMON = 24
#: References of this many languages, under 1 kB each, are broadcast; more are joined by a shuffle.
MOST_LANGUAGES = 10_000


def _with_later(array: str, span: int) -> Column:
    """A hash of each element and the one ``span`` places on."""
    return F.transform(array, lambda x, i: F.xxhash64(x, F.get(array, i + span)))


def with_window_hashes(df: DataFrame, words: str, width: int) -> DataFrame:
    """``df`` plus ``__hashes``: a hash of each window of ``width`` words, a power of two, of an array column, by its start.

    A hash of two words, then of two such hashes and so on, each step one pass over the array. Of two equal
    windows the later one's ``width - k + 1`` hashes of k words all stand earlier too, so a text with fewer repeated
    ones has no equal windows, and its ``__hashes`` are null.
    """
    assert width & (width - 1) == 0, "the width must be a power of two"
    last, span = words, 1
    while span < width:
        made = f"__hashes{span}"
        df = df.withColumn(made, _with_later(last, span))
        last, span = made, 2 * span
        if span < width:
            again = F.size(last) - F.size(F.array_distinct(last))
            df = df.withColumn(last, F.when(again >= width - span + 1, F.col(last)))
    n = F.size(words) - (width - 1)
    df = df.withColumn("__hashes", F.when(n > 0, F.slice(last, F.lit(1), F.greatest(n, F.lit(0)))))
    return df.drop(*[f"__hashes{2**k}" for k in range(width.bit_length())])


def covered(words: str, ordered: str, width: int) -> Column:
    """Words that lie in a window that the text has more than once; ``ordered``: sorted (hash, start) of all windows.

    Windows of one hash count as repeated only if their words agree.
    """
    at = lambda i: F.slice(words, F.get(ordered, i)["i"] + 1, F.lit(width))
    same = lambda x, i, j: F.when(x["h"] == F.get(ordered, j)["h"], at(i) == at(j)).otherwise(F.lit(False))
    again = F.filter(ordered, lambda x, k: same(x, k, k - 1) | same(x, k, k + 1))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i + width - acc["end"])).alias("n"), (i + width).alias("end"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def base_rules(docs: DataFrame, width: int = 8) -> DataFrame:
    """``docs`` plus __words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, row by row.

    Windows are told apart by hash first; only a text in which hashes repeat has its windows sorted.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("__words", word_list(text))
    out = with_window_hashes(out, "__words", width)
    ordered = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__ordered", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), ordered))
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
        "__lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_repeat_words": F.when(F.col("__ordered").isNotNull(), covered("__words", "__ordered", width)).otherwise(0).cast("long"),
    })
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return out.withColumn("base_failed", failed).drop("__hashes", "__ordered", "__lines")


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, v: s + v)


def divergence(a: Column, b: Column, sum_a: Column | None = None, sum_b: Column | None = None) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two arrays of counts of the given sums; null if one of them is null or has none."""
    x, y = (F.nullif(total(c) if n is None else n.cast("double"), F.lit(0.0)) for c, n in ((a, sum_a), (b, sum_b)))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    each = F.zip_with(F.transform(a, lambda v: v / x), F.transform(b, lambda v: v / y), lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.when((x > 0) & (y > 0) & a.isNotNull() & b.isNotNull(), F.sqrt(F.greatest(total(each), F.lit(0.0))))


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def common_words(docs: DataFrame, k: int) -> DataFrame:
    """(lang, top, ref): the k words most frequent in each language, by count and word; their counts, then that of all other words."""
    words = docs.select("lang", F.explode(word_list(F.col("text"))).alias("word"))
    counts = cut(words.groupBy("lang", "word").agg(F.count("*").alias("n")))
    every = counts.groupBy("lang").agg(F.sum("n").cast("double").alias("all"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("place", place).where(F.col("place") <= k).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("t"))
    both = top.alias("a").join(every.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")))
    shown = F.transform("t", lambda x: x["n"].cast("double"))
    rest = F.col("all") - F.aggregate(shown, F.lit(0.0), lambda s, v: s + v)
    return both.select("a.lang", F.transform("t", lambda x: x["word"]).alias("top"), F.concat(shown, F.array(rest)).alias("ref"))


def any_of(words: Column) -> Column:
    """A pattern that matches each word of an array where it stands alone."""
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![^\x20\x09-\x0D])"))


def judge(docs: DataFrame, max_class: tuple = (0.15, 1.2), max_words: tuple = (0.15, 1.7), min_words: int = 50, k: int = COMMON) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_js, word_js, kept
    of every row of (doc_id, text, lang).

    A document is kept unless the base rules fail it or, from ``min_words`` words on, the Jensen-Shannon
    distance of its character classes or of its words from its language's reference passes its
    limit: of (a, b), a + b / sqrt(n_words), as the distance of an ordinary short text is larger by chance.
    References come from all documents: the mean share of each class, in millionths so that sums
    don't depend on order, and the counts of the ``k`` most frequent words and, in one cell, of all others.
    Words are counted with map-side combine; a reference is a row a language.

    Null or empty text: no words, so the base rules fail it. A null language is a language of its own.
    Repeated rows are judged alike. Extra columns aren't returned. An empty table gives an empty result.
    """
    own = docs.select("doc_id", "text", "lang")
    top = small(common_words(own, k).withColumns({"pattern": any_of(F.col("top")), "total": total(F.col("ref"))}), MOST_LANGUAGES)
    rated = base_rules(own).alias("d").join(top.alias("t"), F.col("d.lang").eqNullSafe(F.col("t.lang")), "left").select("d.*", "top", "pattern", "ref", "total")
    judged = (F.col("n_words") >= min_words) & ~F.col("base_failed")
    rated = rated.withColumn("__shown", F.when(judged & (F.size("top") > 0), F.regexp_extract_all("text", F.col("pattern"), F.lit(0))))
    each = F.transform("top", lambda w: (F.size("__shown") - F.size(F.array_remove("__shown", w))).cast("double"))
    other = F.array((F.col("n_words") - F.size("__shown")).cast("double"))
    rated = rated.withColumn("__hist", F.when(F.col("__shown").isNotNull(), F.concat(each, other)))
    counted = [F.length(F.regexp_replace(F.coalesce("text", F.lit("")), f"[^{c}]+", "")) for c in CLASSES.values()]
    rated = rated.withColumn("__n", F.length(F.coalesce("text", F.lit(""))))
    rated = rated.withColumn("__some", F.array(*counted, F.col("__n") - F.col("word_chars"), F.col("n_symbols")))
    classes = F.concat("__some", F.array(F.col("__n") - F.aggregate("__some", F.lit(0).cast("long"), lambda s, v: s + v)))
    millionths = F.transform(classes, lambda v: F.floor(v * F.lit(1_000_000) / F.greatest(F.col("__n"), F.lit(1))))
    rules = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rated = cut(rated.select("doc_id", "lang", *rules, millionths.alias("classes"), divergence(F.col("__hist"), F.col("ref"), F.col("n_words"), F.col("total")).alias("word_js")))
    size = len(CLASSES) + 3
    means = small(rated.where(F.col("n_words") >= min_words).groupBy("lang").agg(F.array(*[F.sum(F.get("classes", F.lit(i))).cast("double") for i in range(size)]).alias("mean")).withColumn("sum", total(F.col("mean"))), MOST_LANGUAGES)
    out = rated.alias("d").join(means.alias("m"), F.col("d.lang").eqNullSafe(F.col("m.lang")), "left").select("d.*", "mean", "sum")
    out = out.withColumns({"__shares": F.col("classes").cast("array<double>")}).withColumn("__sum", total(F.col("__shares")))
    out = out.withColumn("class_js", F.when(F.col("n_words") >= min_words, divergence(F.col("__shares"), F.col("mean"), F.col("__sum"), F.col("sum"))))
    over = lambda c, limit: F.coalesce(F.col(c), F.lit(0.0)) > limit[0] + limit[1] / F.sqrt(F.greatest("n_words", F.lit(1)))
    far = over("class_js", max_class) | over("word_js", max_words)
    return out.select("doc_id", *rules, "class_js", "word_js", (~F.col("base_failed") & ~far).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("class_js", "word_js")
