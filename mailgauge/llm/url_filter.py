"""Operator 3: URL filters by host word segmentation and naive Bayes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm.common import ascii_lower, cut, table

#: Fixed values: (verdict, host, path) of the query's rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words that mark a page as unwanted when the classifier learns.
SEEDS = (
    "adult adults ads advert bet bets betting bingo casino cheap dating escort gamble gambling hack jackpot loan loans lottery "
    "malware nude payday phish phishing pills poker porn pron replica sex slots spam spyware torrent track tracker viagra virus warez webcam xxx"
).split()
#: Host labels that say nothing.
IDLE = frozenset("www com net org de fr es uk co io".split())
#: The unigram model knows each word that is at least one in so many of all words; so it knows at most as many words.
RARE = 200_000
_LETTERS = re.compile(r"[a-z]+")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path; both empty without ``://`` and for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), else null."""
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*pick) if pick else F.lit(None).cast("struct<rule:string,verdict:string>")


class Segmenter:
    """Splits a run of letters into the words of largest joint unigram probability, by Viterbi."""

    def __init__(self, counts: dict[str, int]):
        total = max(1, sum(counts.values()))
        floor = max(1.0, total * 1e-6)  # seeds are known words even where the texts lack them
        self.score = {w: math.log(n / total) for w, n in counts.items() if n > 0}
        for w in SEEDS:
            self.score[w] = math.log(max(counts.get(w, 0), floor) / total)
        # A word unknown to the model gets less with each letter.
        self.start, self.letter = math.log(10 / total), math.log(10)
        self.words: ahocorasick.Automaton | None = None
        self.kept: dict[str, list[str]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None, "kept": {}}

    def ending(self, run: str) -> dict[int, list[str]]:
        """The known words of a run by the place behind their last letter."""
        if self.words is None:
            self.words = ahocorasick.Automaton()
            for w in self.score:
                self.words.add_word(w, w)
            self.words.make_automaton()
        out: dict[int, list[str]] = {}
        for at, word in self.words.iter(run):
            out.setdefault(at + 1, []).append(word)
        return out

    def __call__(self, run: str) -> list[str]:
        if run in self.kept:
            return self.kept[run]
        # Known words come from the automaton; of the places where an unknown word could start only the best is held, so
        # time is that of the run's letters and of the known words in it.
        best, back, known = [0.0], [0], self.ending(run)
        start, worth = 0, 0.0
        for end in range(1, len(run) + 1):
            if (here := best[end - 1] + (end - 1) * self.letter) >= worth:
                start, worth = end - 1, here
            ways = [(best[start] + self.start - (end - start) * self.letter, start)]
            ways += [(best[end - len(w)] + self.score[w], end - len(w)) for w in known.get(end, ())]
            choice = max(ways)
            best.append(choice[0])
            back.append(choice[1])
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        out.reverse()
        if len(self.kept) < 100_000 and len(run) < 64:
            self.kept[run] = out
        return out

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host's labels, but the idle ones, and of the path; those of the path apart by a slash in front."""
        out = [w for run in _LETTERS.findall(host) if run not in IDLE for w in self(run)]
        return out + ["/" + w for run in _LETTERS.findall(path.lower()) for w in self(run)]


def frequent(counts: DataFrame, rare: int) -> DataFrame:
    """The rows of (..., n) whose n is at least one in ``rare`` of the sum of n: at most ``rare`` rows, whatever the input's size."""
    counts = cut(counts)
    every = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * rare >= every)


def word_counts(pages: DataFrame, html_col: str = "html", rare: int = RARE) -> dict[str, int]:
    """Counts of the words of all pages' texts that are at least one in ``rare`` of them; those counts alone reach the driver."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(html_col), F.lit(""))), r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(text, r"[^a-z]+")).alias("w")).where("w <> ''")
    return {r.w: r.n for r in frequent(words.groupBy("w").agg(F.count("*").alias("n")), rare).collect()}


def learn(urls: DataFrame, segmenter: Segmenter) -> tuple[DataFrame, float]:
    """Multinomial naive Bayes over (host, path): (token, odds) of each token's log-odds, with add-one smoothing, and the prior's.

    A URL counts as unwanted if a word of its host is a seed. Tokens are counted over all rows, first in
    each batch, and all have an odds of their own, in a table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = frozenset(SEEDS)
        for b in batches:
            seen = Counter()
            for host, path in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True):
                tokens = segmenter.tokens(host, path)
                bad = not seeds.isdisjoint(tokens)
                seen.update((t, bad) for t in tokens)
                seen["", bad] += 1
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["token", "bad", "n"])

    rows = urls.mapInArrow(run, "token string, bad boolean, n long")
    by = rows.groupBy("token").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good"))
    by = cut(by)
    pages, words = by.where("token = ''").first(), by.where("token <> ''")
    if not pages or not pages.bad or not pages.good:
        return words.limit(0).select("token", F.lit(0.0).alias("odds")), -math.inf
    r = words.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("n")).first()
    odds = F.log((F.col("bad") + 1) / F.lit((r.bad or 0) + r.n + 1)) - F.log((F.col("good") + 1) / F.lit((r.good or 0) + r.n + 1))
    return words.select("token", odds.alias("odds")), math.log(pages.bad / pages.good)


def score(urls: DataFrame, segmenter: Segmenter, odds: DataFrame) -> DataFrame:
    """(host, path, known) of each different URL of (host, path) that has a known token: the sum of its tokens' odds, in decimals, so that it doesn't depend on order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, p, t, n) for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True) for t, n in Counter(segmenter.tokens(h, p)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["host", "path", "token", "n"])

    tokens = urls.distinct().mapInArrow(run, "host string, path string, token string, n long").join(odds, "token")
    part = F.col("n").cast("decimal(10,0)") * F.col("odds").cast("decimal(16,12)")
    return tokens.groupBy("host", "path").agg(F.sum(part).cast("double").alias("known"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", html_col: str = "html", rare: int = RARE) -> DataFrame:
    """``pages`` plus host, path, rule, verdict and block_odds, the classifier's log-odds for blocking.

    The longest fitting rule decides; without one the classifier does, blocking at log-odds over 0. ``rare``: the segmenter
    knows the words that are at least one in so many of all words of the pages, by their share at every size; so as many
    words at most. A null URL or one without ``://`` has no tokens and is allowed, as is every URL of a table from which
    nothing can be learnt. Very long URLs and texts: linear time. Repeated rows are judged alike; other columns pass
    through, whatever their names, but for ones of the added names, which are replaced. Empty table: an empty result.
    """
    made = ("host", "path", "rule", "verdict", "block_odds")
    pages = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in made]).alias("__all"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    host, path = url_parts(F.col("url"))
    parts = pages.select(host.alias("host"), path.alias("path"))
    segmenter = Segmenter(word_counts(pages, "html", rare))
    odds, prior = learn(parts, segmenter)

    known = score(parts, segmenter, odds).select(F.col("host").alias("__host"), F.col("path").alias("__path"), "known")
    out = pages.select("__all", host.alias("host"), path.alias("path"))
    out = out.withColumn("__best", best_rule(F.col("host"), F.col("path"), rules)).join(known.withColumnRenamed("known", "__known"), (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    out = out.withColumn("block_odds", F.coalesce(F.lit(prior) + F.col("__known"), F.lit(-math.inf)))
    own = F.when(F.col("block_odds") > 0, "block").otherwise("allow")
    return out.withColumn("rule", F.col("__best.rule")).withColumn("verdict", F.coalesce(F.col("__best.verdict"), own)).select("__all.*", *made)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "block_odds")
