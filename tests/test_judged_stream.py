"""Judges' verdicts in time, late, missing and double, over restarts."""

from pyspark.sql import functions as F

from mailgauge.operators import verdict as V
from mailgauge.streaming import stream


def test_verdicts_in_time_late_missing_and_double(spark, tmp_path):
    def messages(name, *rows):
        df = spark.createDataFrame(rows, "email_id long, minute int, raw_score int")
        df.select("email_id", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, minute, 0)").alias("ts"), "raw_score").coalesce(1).write.json(str(tmp_path / "mail" / name))

    def verdicts(name, *rows):
        df = spark.createDataFrame(rows, "email_id long, minute int, judge string, judge_confidence double")
        at = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, minute, 0)").alias("judged_at")
        df.select("email_id", at, "judge", "judge_confidence").coalesce(1).write.json(str(tmp_path / "judge" / name))

    def run():
        mail = spark.readStream.schema("email_id long, ts timestamp, raw_score int").json(str(tmp_path / "mail" / "*"))
        out = stream.judged_stream(mail, stream.read_verdicts(spark, str(tmp_path / "judge" / "*")), "10 minutes", "30 minutes")
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
        return {r.email_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}, spark.read.parquet(str(tmp_path / "out")).count()

    messages("a", (1, 0, 20), (2, 1, 32), (3, 2, 32), (4, 3, 10), (5, 4, 80), (None, 4, 5), (6, 5, 25))
    verdicts("a", (1, 5, "phishing", 0.9), (2, 30, "benign", 0.9), (4, 4, "phishing", 0.6), (9, 4, "phishing", 1.0), (6, 6, None, 0.9))
    got, _ = run()
    assert set(got) == {1, 4} and (got[1].final_verdict, got[1].decided_by, got[4].final_verdict) == ("phishing", "judge", "suspicious")
    verdicts("b", (4, 9, "benign", 0.9), (5, 5, "benign", None), (7, 200, "benign", 0.5))  # a second verdict, one without a confidence
    messages("b", (7, 199, 15), (8, 200, 0))
    got, rows = run()
    assert set(got) >= {1, 2, 3, 4, 5, 6, 7} and rows == len(got)
    assert [got[i].decided_by for i in (1, 2, 3, 4, 5, 6, 7)] == ["judge", "deterministic", "deterministic", "judge", "judge", "deterministic", "judge"]
    assert (got[2].final_verdict, got[2].final_score, got[3].final_verdict, got[5].final_verdict, got[6].final_verdict) == ("phishing", 35, "phishing", "phishing", "benign")
    assert got[4].judge == "phishing"
    messages("c", (1, 0, 99))  # too late
    _, again = run()
    assert again == rows


def test_merge_is_that_of_tables(spark):
    df = spark.createDataFrame([(s, j, c) for s in (0, 15, 25, 32, 60) for j in ("benign", "suspicious", "phishing", "odd") for c in (0.0, 0.6, 0.9)], "s int, j string, c double")
    r = df.select(V.merge_judge(F.col("s"), F.col("j"), F.col("c")).alias("v"), "s").collect()
    assert {x.v for x in r if x.s == 60} == {"phishing"}
