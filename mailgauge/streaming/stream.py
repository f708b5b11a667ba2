"""The same triage over a stream, judges' verdicts that come later, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.operators import verdict as V
from mailgauge.operators.score import Policy
from mailgauge.plans import triage as P

MAIL = "email_id long, ts timestamp, subject string, text string, sender string, reply_to string, auth string, received string, attachment string"


def read_mail(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of JSON files of messages."""
    return spark.readStream.schema(MAIL).option("maxFilesPerTrigger", files_per_batch).json(folder)


def triage_stream(mail: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Records with the time of their messages, as these come; stateless, so appended.

    The time travels in the id, as a stream can't be joined with itself without state.
    """
    out = P.triage(mail.withColumn("email_id", F.struct("email_id", "ts")), p=p)
    return out.select("email_id.*", *[c for c in out.columns if c != "email_id"])


def verdict_counts(triaged: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Messages and mean risk by window and verdict; what comes later than ``late`` is left out."""
    by = triaged.withWatermark("ts", late).groupBy(F.window("ts", window), "verdict")
    return by.agg(F.count("*").alias("messages"), F.avg("risk_score").alias("mean_risk")).select(F.col("window.start").alias("start"), "verdict", "messages", "mean_risk")


#: Verdicts of judges as JSON files hold them.
VERDICTS = "email_id long, judged_at timestamp, judge string, judge_confidence double"


def read_verdicts(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of JSON files of judges' verdicts."""
    return spark.readStream.schema(VERDICTS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def judged_stream(triaged: DataFrame, verdicts: DataFrame, wait: str = "10 minutes", late: str = "30 minutes", p: Policy = Policy()) -> DataFrame:
    """``triaged`` plus judge, judge_confidence, decided_by, final_verdict and final_score, a row a message, appended once it is final.

    A judge's verdict on a message counts if it was given up to ``wait`` after the message's time; of several the first
    to come. Without one the deterministic verdict is final as soon as both streams have passed that time by ``late``:
    until then, and no longer, messages and verdicts are held as state, by id. Rows without an id or a time, and what comes later
    than ``late``, are left out. Verdicts without a confidence count as of none.
    """
    said = verdicts.where("judge is not null").withWatermark("judged_at", late).dropDuplicatesWithinWatermark(["email_id"])
    said = said.select(F.col("email_id").alias("of"), "judged_at", "judge", F.coalesce("judge_confidence", F.lit(0.0)).alias("judge_confidence"))
    within = (F.col("email_id") == F.col("of")) & (F.col("judged_at") >= F.col("ts")) & (F.col("judged_at") <= F.col("ts") + F.expr(f"interval {wait}"))
    both = triaged.where("email_id is not null").withWatermark("ts", late).join(said, within, "leftOuter")
    return both.select(*triaged.columns, "judge", "judge_confidence", *V.judged(p))
