"""The tools by SQL: names, plans without Python, the same answers as the column functions."""

from pyspark.sql import functions as F

from mailgauge.functions import sql
from mailgauge.operators import stages as G


def test_tools_by_sql(spark):
    names = sql.register(spark)
    assert sql.register(spark) == names and len(names) == 10 and set(G.TOOLS) <= set(names)
    listed = {r.function.rsplit(".", 1)[-1] for r in spark.sql("SHOW USER FUNCTIONS").collect()}
    assert set(names) <= listed
    texts = ["Urgent: verify your account at https://bit.ly/x or https://b.example/?u=%41", "it's \\ a 'quoted'\ttext", "", None]
    df = spark.createDataFrame([(t, "a.exe") for t in texts], "text string, file string")
    got = spark.sql("SELECT text, normalize_text(text) n, keyword_scan(text) k, extract_urls(text) u, route_path(text, extract_urls(text).urls, array(file)) r, attachment_risk(file) a, parse_email(text) m FROM {df}", df=df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "keyword_scan(" not in plan
    urls = G.tool("extract_urls", F.col("text"))
    want = df.select("text", G.tool("normalize_text", F.col("text")), G.tool("keyword_scan", F.col("text")), urls, G.tool("route_path", F.col("text"), urls["urls"], F.array("file")), G.tool("attachment_risk", F.col("file")))
    assert [tuple(r)[:6] for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_targets_by_sql(spark):
    sql.register(spark)
    rows = [("https://a.example/?u=%41", True), ("http://10.0.0.1/", True), ("http://10.0.0.1/", False), ("ftp://a.example", True), ("", False), (None, True)]
    got = spark.sql("SELECT url_target(url, on) t FROM {df}", df=spark.createDataFrame(rows, "url string, on boolean")).collect()
    assert [(r.t.status, r.t.refused, r.t.risk_score) for r in got] == [("not_fetched", None, 6), ("blocked", "private_network_blocked", 20), ("skipped", None, 0), ("blocked", "unsupported_scheme", 20), ("blocked", "empty_url", 20), ("blocked", "empty_url", 20)]
