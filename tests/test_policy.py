"""Settings by precedence, coerced, and a policy for each message in one plan."""

import pytest
from pyspark.sql import functions as F

from mailgauge.operators import policy as Y
from mailgauge.operators.score import Policy
from mailgauge.plans import triage as P

MAIL = "email_id string, subject string, text string, sender string, reply_to string, auth string, received string, attachment string, profile string"


def test_precedence(spark):
    rows = [("a", "review", "10"), ("a", "deep", "-1"), ("a", "url_weight", "x"), (None, "deep", "77"), (None, "url_weight", " 5 "), (None, "review", "0"), ("a", "unknown", "3"), ("b", "review", "+12"), ("b", "deep", "99999999999")]
    settings = spark.createDataFrame(rows, "profile string, name string, value string")
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "profile string")
    got = {r.profile: r.policy for r in Y.with_policy(df, settings, {"path_cap": "9", "path_bonus": "no"}).collect()}
    assert [(got[k].review, got[k].deep, got[k].url_weight, got[k].path_cap, got[k].path_bonus) for k in ("a", "b", "c", None)] == [(10, 77, 5, 9, 8), (12, 77, 5, 9, 8), (30, 77, 5, 9, 8), (30, 77, 5, 9, 8)]
    none = Y.with_policy(df, settings.limit(0)).collect()
    assert all(r.policy.asDict() == {n: getattr(Policy(), n) for n in Y.NAMES} for r in none)


def test_two_profiles_in_one_plan(spark):
    text = "urgent: verify your password at https://bit.ly/reset and pay the invoice"
    rows = [(f"{i}{p}", "Notice", t, "", "", "", "", f, p) for i, (t, f) in enumerate([(text, ""), ("hello", "a.exe"), ("https://bit.ly/x", "")]) for p in ("low", "high")]
    mail = spark.createDataFrame(rows, MAIL)
    policies = {"low": Policy().but(review=5, deep=20, url_weight=3, suspicious_min=8, suspicious_max=9, keyword_weight=2, core_bonus=90), "high": Policy().but(review=60, url_weight=50, context_trigger=1)}
    settings = spark.createDataFrame([(k, n, str(getattr(p, n))) for k, p in policies.items() for n in Y.NAMES], "profile string, name string, value string")
    columns = ["email_id", "raw_score", "risk_score", "route", "verdict", "indicators", "url_signals", "attachment_admission", "web_admission"]
    got = P.triage(Y.with_policy(mail, settings), p=Y.PolicyColumn()).select(columns)
    want = [r for k, p in policies.items() for r in P.triage(mail.where(F.col("profile") == k).drop("profile"), p=p).select(columns).collect()]
    assert sorted(got.collect()) == sorted(want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("text", "label"), [("Phishing", 1), ("1.0", 1), (" ham ", 0), ("Safe Email", 0), ("Phishing Email", 1), ("non-phishing email", 0), ("unsafe", 0), ("spam!", 1), ("maybe", None), ("", None), (None, None), ("Legit  Email", 0)])
def test_labels(spark, text, label):
    assert spark.createDataFrame([(text,)], "t string").select(Y.binary_label(F.col("t")).alias("x")).first().x == label


def test_coercion(spark):
    values = ["5", " 7 ", "0", "-2", "5.0", "x", "", None, "2147483648", "1e3", "YES", "off", "é"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    v = F.col("v")
    rows = df.select("i", Y.positive_int(v, F.lit(8)).alias("n"), Y.number(v, F.lit(-1.0)).alias("x"), Y.truth(v, F.lit(None).cast("boolean")).alias("t"), Y.is_true(v).alias("b"), Y.choices(F.concat_ws(",", v, v, F.lit(" a "))).alias("c")).orderBy("i").collect()
    assert [r.n for r in rows] == [5, 7, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8]
    assert [r.x for r in rows] == [5.0, 7.0, 0.0, -2.0, 5.0, -1.0, -1.0, -1.0, 2147483648.0, 1000.0, -1.0, -1.0, -1.0]
    assert [r.t for r in rows] == [None, None, False, None, None, None, None, None, None, None, True, False, None] and [r.b for r in rows] == [r.t is True for r in rows]
    assert rows[0].c == ["5", "a"] and rows[7].c == ["a"]
