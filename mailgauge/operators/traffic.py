"""Grouped and windowed analytics of event streams: entropy, rates, regularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entropy(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, kinds, entropy): Shannon entropy in bits of the values of each key; counts combine before the shuffle."""
    c = events.groupBy(key, value).agg(F.count("*").alias("n"))
    sums = c.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(key, "n", "kinds", (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def rate_spikes(events: DataFrame, time: str = "ts", ratio: float = 2.0, minutes: int = 1) -> DataFrame:
    """One row: windows, most and mean events a window, and whether most passes ``ratio`` times the mean."""
    per = events.groupBy(F.window(time, f"{minutes} minutes")).agg(F.count("*").alias("n"))
    out = per.agg(F.count("*").alias("windows"), F.max("n").alias("most"), F.avg("n").alias("mean"))
    return out.withColumn("spike", F.col("most") > ratio * F.col("mean"))


def beacons(events: DataFrame, key: str = "user_id", time: str = "ts", most: float = 0.5) -> DataFrame:
    """(key, gaps, cv, beacon): variation of the times between events of a key, population deviation over mean."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    gap = (at - F.lag(at).over(Window.partitionBy(key).orderBy(time))) / 1e6
    out = events.withColumn("gap", gap).groupBy(key).agg(F.count("gap").alias("gaps"), F.try_divide(F.stddev_pop("gap"), F.avg("gap")).alias("cv"))
    return out.withColumn("beacon", F.coalesce(F.col("cv") < most, F.lit(False)))


def gap_variation(events: DataFrame, time: str = "ts", minutes: int = 1) -> DataFrame:
    """One row (gaps, cv): variation of the times between all events.

    Gaps are taken within windows of some minutes; those between windows come from a table of a row a window.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    e = events.select(at.alias("at"), F.floor(at / (minutes * 60_000_000)).alias("w"))
    gap = (F.col("at") - F.lag("at").over(Window.partitionBy("w").orderBy("at"))) / 1e6
    per = e.withColumn("gap", gap).groupBy("w").agg(F.count("gap").alias("n"), F.sum("gap").alias("s"), F.sum(F.col("gap") * F.col("gap")).alias("q"), F.min("at").alias("low"), F.max("at").alias("high"))
    step = (F.col("low") - F.lag("high").over(Window.orderBy("w"))) / 1e6
    sums = per.withColumn("step", step).agg((F.sum("n") + F.count("step")).alias("gaps"), *[(F.coalesce(F.sum(c), F.lit(0.0)) + F.coalesce(F.sum(x), F.lit(0.0))).alias(c) for c, x in (("s", F.col("step")), ("q", F.col("step") * F.col("step")))])
    mean = F.try_divide(F.col("s"), F.col("gaps"))
    return sums.select("gaps", F.try_divide(F.sqrt(F.greatest(F.try_divide(F.col("q"), F.col("gaps")) - mean * mean, F.lit(0.0))), mean).alias("cv"))


def port_scans(events: DataFrame, key: str, port: str, syn_only: str, least: int = 50) -> DataFrame:
    """(key, n, ports, entropy, syn_ratio, scan): a scan has many ports, spread evenly, and mostly unanswered openings.

    ``syn_only``: a boolean column. Counts combine by key and port before the shuffles.
    """
    c = events.groupBy(key, port).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(syn_only), F.lit(False))).alias("opened"))
    sums = c.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("ports"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.sum("opened").alias("opened"))
    out = sums.select(key, "n", "ports", (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"), (F.col("opened") / F.col("n")).alias("syn_ratio"))
    # What all of a scan's figures must pass.
    return out.withColumn("scan", (F.col("n") >= least) & (F.col("entropy") > 6.0) & (F.col("syn_ratio") > 0.7) & (F.col("ports") > 100))


def assess(events: DataFrame, key: str, port: str, syn_only: str, time: str = "ts", dos_ratio: float = 20.0, beacon_cv: float = 0.5) -> DataFrame:
    """One row (port_scan, dos, beaconing, benign): benign if no detection of the three is true."""
    scans = port_scans(events, key, port, syn_only).agg(F.coalesce(F.bool_or("scan"), F.lit(False)).alias("port_scan"))
    rates = rate_spikes(events, time, dos_ratio).select(F.coalesce("spike", F.lit(False)).alias("dos"))
    gaps = gap_variation(events, time).select(F.coalesce(F.col("cv") < beacon_cv, F.lit(False)).alias("beaconing"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    out = one(scans).join(one(rates), "__one").join(one(gaps), "__one").drop("__one")
    return out.withColumn("benign", ~(F.col("port_scan") | F.col("dos") | F.col("beaconing")))


def best_match(names: DataFrame, known: list[str], col: str = "name", cutoff: float = 0.6) -> DataFrame:
    """``names`` with the known word of the largest edit similarity, null below the cutoff; the words are literals."""
    ratio = lambda b: 1 - F.levenshtein(F.col(col), b) / F.greatest(F.length(col), F.length(b), F.lit(1))
    rated = F.array_sort(F.transform(F.array(*map(F.lit, known)), lambda b: F.struct((-ratio(b)).alias("r"), b.alias("b"))))
    top = F.get(rated, F.lit(0))
    return names.withColumn("similarity", -top["r"]).withColumn("match", F.when(-top["r"] >= cutoff, top["b"]))
