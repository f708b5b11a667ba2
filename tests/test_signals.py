"""Signals, scores and verdicts of single messages against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from mailgauge.functions import attachment as A
from mailgauge.functions import html
from mailgauge.functions.arrow import canonical
from mailgauge.functions import header as H
from mailgauge.functions import text as T
from mailgauge.functions import url as U
from mailgauge.operators import evidence as E
from mailgauge.operators import traffic as X
from mailgauge.operators import verdict as V
from mailgauge.operators.score import Policy
from mailgauge.plans import triage as P
from mailgauge.sources.messages import parse, parse_messages

MAIL = "email_id string, subject string, text string, sender string, reply_to string, auth string, received string, attachment string"


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(*columns).first()


def triaged(spark, subject="", text="", attachment="", policy=None, auth="", received=""):
    df = spark.createDataFrame([("m", subject, text, "", "", auth, received, attachment)], MAIL)
    return P.triage(df, p=policy or Policy()).first()


def test_harmless(spark):
    r = triaged(spark, text="hello team")
    assert (r.raw_score, r.route, r.path, r.verdict, r.confidence, r.labels.email_label, r.indicators) == (0, "allow", "FAST", "benign", 0.35, "benign", [])


def test_short_link(spark):
    r = triaged(spark, subject="Notice", text="https://bit.ly/reset")
    assert (r.raw_score, r.route, r.verdict, r.confidence, r.labels.email_label) == (44, "review", "phishing", 0.59, "phish_email")
    assert r.url_signals[0].risk_flags == ["shortlink", "suspicious-pattern"] and r.components.url == 28
    assert r.indicators == ["contains_url"] and r.web_admission.status == "skipped_by_policy"


def test_program_attachment(spark):
    r = triaged(spark, subject="Notice", attachment="invoice.exe")
    assert (r.raw_score, r.route, r.verdict, r.confidence, r.components.attachment) == (14, "allow", "benign", 0.43, 30)
    assert r.attachment_admission.status == "admitted"


def test_lower_weight_lowers_the_score(spark):
    text = "https://bit.ly/reset"
    assert triaged(spark, text=text, policy=Policy().but(url_weight=5)).raw_score < triaged(spark, text=text).raw_score


def test_header_results(spark):
    r = triaged(spark, text="x", auth="spf=pass; spf=softfail dkim=fail dmarc=fail p=reject", received="Received: from 10.1.2.3")
    assert (r.header.spf, r.header.dkim, r.header.dmarc, r.header.received_patterns, r.raw_score) == ("softfail", "fail", "fail", ["private_ip_in_received_chain"], 48)


@pytest.mark.parametrize(("url", "want"), [("HTTP://A.Com/B?", "http://a.com/B"), ("https://x.y/#", "https://x.y/"), ("http://x.y/a?#f", "http://x.y/a#f"), ("nothing", "nothing")])
def test_canonical_url(spark, url, want):
    assert one(spark, U.canonicalize(F.col("u")).alias("u"), u=url).u == want == canonical(url)


@pytest.mark.parametrize(("host", "brands", "risk"), [("micros0ft.com", ["microsoft"], 30), ("paypal-billing.com", ["paypal"], 36), ("secure-login-update-pay.xyz", [], 66), ("xn--a.org", [], 45), ("example.org", [], 0)])
def test_domains(spark, host, brands, risk):
    r = one(spark, U.typosquat_brands(F.col("h")).alias("b"), U.domain_risk(F.col("h")).alias("r"), h=host)
    assert (r.b, r.r) == (brands, risk)


@pytest.mark.parametrize(
    ("score", "judge", "confidence", "low", "want"),
    [(46, "benign", 0.95, 24, "phishing"), (30, "suspicious", 0.4, 24, "suspicious"), (28, "benign", 0.9, 24, "benign"), (18, "phishing", 0.9, 24, "phishing"), (18, "phishing", 0.7, 24, "suspicious"), (23, "benign", 0.4, 24, "suspicious")],
)
def test_judge(spark, score, judge, confidence, low, want):
    p = Policy().but(suspicious_min=low)
    assert one(spark, V.merge_judge(F.lit(score), F.lit(judge), F.lit(confidence), p).alias("v")).v == want


def test_clamp(spark):
    p = Policy().but(suspicious_min=24, suspicious_max=40)
    got = one(spark, *[V.clamp(F.lit(s), F.lit(v), p).alias(v) for s, v in ((27, "benign"), (49, "suspicious"), (30, "phishing"))])
    assert tuple(got) == (23, 40, 41)


def test_evaluation(spark):
    df = spark.createDataFrame([("phishing", "phishing"), ("benign", "benign"), ("suspicious", "benign"), ("benign", "phishing")], "predicted string, truth string")
    r = E.evaluate(df).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.accuracy, r.precision, r.recall, r.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    assert E.evaluate(df.limit(0)).first().f1 == 0


def test_evidence_numbers_and_paths(spark):
    e = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "a")], "email_id int, seq int, fingerprint string")
    assert {(r.email_id, r.fingerprint, r.evidence_id) for r in E.number_evidence(e).collect()} == {(1, "a", "evd_0001"), (1, "b", "evd_0002"), (2, "a", "evd_0001")}
    known = spark.createDataFrame([(1, "url.first", "evd_0001"), (1, "url", "evd_0009")], "email_id int, path string, evidence_id string")
    asked = spark.createDataFrame([(1, "url.first.flags"), (1, "url.second"), (1, "mail")], "email_id int, path string")
    assert {(r.path, r.evidence_id) for r in E.resolve(asked, known).collect()} == {("url.first.flags", "evd_0001"), ("url.second", "evd_0009"), ("mail", None)}


def test_last_report_wins(spark):
    s = spark.createDataFrame([(1, "a.pdf")], "email_id int, name string")
    r = spark.createDataFrame([(1, 0, "a.pdf", "pdf", 5, False), (1, 1, "a.pdf", "zip", 9, True)], "email_id int, pos int, name string, type string, risk_score int, macro_like boolean")
    assert E.enrich_attachments(s, r).first().type == "zip"


def test_issues(spark):
    none = F.lit(None).cast("string")
    assert one(spark, V.issues(F.lit("odd"), F.lit("999"), F.array(), none).alias("i")).i == ["invalid_verdict", "invalid_risk_score_range"]
    assert one(spark, V.issues(F.lit("phishing"), F.lit("x"), F.array(), none).alias("i")).i == ["invalid_verdict", "invalid_risk_score_type", "invalid_risk_score_range", "missing_indicators", "missing_evidence"][1:]


def test_sampling_is_stable(spark):
    df = spark.range(2000).select(V.sampled(F.col("id").cast("string"), 0.3, "s").alias("s"))
    assert 480 < df.where("s").count() < 720 and not one(spark, V.sampled(F.lit("a"), 0.0).alias("s")).s


def test_redaction(spark):
    r = one(spark, T.redact_text(F.col("a")).alias("a"), T.redact_url(F.col("b")).alias("b"), a="mail john.doe@example.com " + "k" * 31, b="https://x.y/p?token=abc&q=1#f")
    assert r.a == "mail jo***@example.com <redacted-token>"
    assert r.b.startswith("https://x.y/p?token=%3Credacted%3Aba7816bf8f01%3E&q=1")


def test_html_features():
    f = html.features('<title>T</title><form><input type="password" name="otp"></form><iframe></iframe><a href="https://evil.example">https://bank.example/x</a><script src="//c.example/x.js">password</script>verify account')
    assert (f["title"], f["forms"], f["passwords"], f["otps"], f["iframes"], f["external_scripts"], f["keywords"], f["hidden_links"]) == ("T", 1, 1, 1, 1, 1, ["verify account"], ["https://evil.example"])
    assert html.features(None)["forms"] == 0


EML = "Subject: Hi\nFrom: A <a@b.com>\nTo: c@d.e\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=X\n\n--X\nContent-Type: text/html\n\n<a href=\"https://evil.example/a\">https://bank.example</a>\n--X\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=\"a.pdf\"\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n--X--\n"


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, "empty"), ("  ", "empty"), ("plain text", "text"), ('{"subject": "s", "urls": ["u"]}', "json"), ("{not json}", "text"), ("Subject: a\nbody", "header_block"), ("Subject: a\nFrom: b\n\nbody", "eml"), (EML, "eml"), ("Date: a\n\nbody", "text")],
)
def test_formats(raw, want):
    assert parse(raw)["format"] == want


def test_parsed_columns(spark):
    r = parse_messages(spark.createDataFrame([(EML,), (None,)], "raw string")).where("format = 'eml'").first()
    assert (r.subject, r.to, r.attachments, r.urls) == ("Hi", ["c@d.e"], ["a.pdf"], ["https://evil.example/a", "https://bank.example"])
    assert r.attachment_hashes["a.pdf"].startswith("2cf24dba")


def test_attachment_types(spark):
    df = spark.createDataFrame([("a.bin", bytearray(b"%PDF-1 /JavaScript /Annots http://x.y")), ("b.DOC", bytearray(b"zz")), ("c", bytearray(b"<html>"))], "name string, data binary")
    got = df.select(A.magic_type(F.col("data"), F.col("name")).alias("t"), A.pdf_score(F.col("data")).alias("p"), A.extension_mismatch(F.col("name"), F.lit("pdf")).alias("m")).collect()
    assert [r.t for r in got] == ["pdf", "ole", "html"] and got[0].p == 30 + 20 + 4 and [r.m for r in got] == [True, True, False]


def test_fuzzy(spark):
    r = X.best_match(spark.createDataFrame([("paypa1",), ("zzz",)], "name string"), ["paypal", "apple"]).collect()
    assert [x.match for x in r] == ["paypal", None]


def test_stream(spark, tmp_path):
    from mailgauge.streaming import stream

    rows = [(i, f"2024-01-01 00:{i:02d}:00", "Notice", "https://bit.ly/reset" if i % 2 else "hello", "", "", "", "", "") for i in range(20)]
    cols = "email_id long, ts string, subject string, text string, sender string, reply_to string, auth string, received string, attachment string"
    spark.createDataFrame(rows, cols).withColumn("ts", F.to_timestamp("ts")).write.json(str(tmp_path / "in"))
    counted = stream.verdict_counts(stream.triage_stream(stream.read_mail(spark, str(tmp_path / "in"))))
    q = counted.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(str(r.start)[14:16], r.verdict): r.messages for r in spark.table("counts").collect()} == {("00", "phishing"): 5, ("00", "benign"): 5, ("10", "phishing"): 5, ("10", "benign"): 5}


def test_url_redaction_decodes_first(spark):
    urls = ["https://docs.example.net/c?u=https%3A%2F%2Fevil.example%2Fx", "https://x.y/?q=a+b%20c*~&flag&Token=%41", "https://x.y/?v=%E2%82%ACabcdefghijklmnopqrstuvwxyz#f", "https://x.y/p?&", "https://x.y/?bad=100%"]
    from mailgauge.functions.redact import redacted

    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(T.redact_url(F.col("u"))).collect()]
    assert got == [redacted(u) for u in urls]


def test_folded_lines_are_no_hops(spark):
    r = one(spark, H.header_signals(F.col("a"), F.col("b"), F.lit("x@y.zz"), F.lit("")).alias("h"), a="", b="X: a\n Received: from 10.0.0.1\r\nReceived: from mx").h
    assert r.hops == 1 and r.received_patterns == []


def test_ipv6_literals(spark):
    urls = {"http://[::1]:80/x": "::1", "http://u@[FE80::1]/": "fe80::1", "http://[2606:4700::1111]/": "2606:4700::1111", "http://[::ffff:10.0.0.1]/": "::ffff:10.0.0.1", "http://a.example:8/": "a.example"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.hostname(F.col("u")).alias("h"), U.fetch_refusal(F.col("u")).alias("r")).collect()
    assert {r.u: r.h for r in rows} == urls
    assert [r.r for r in rows] == ["private_network_blocked", "private_network_blocked", None, "private_network_blocked", None]


def test_white_space_at_the_ends(spark):
    r = one(spark, T.strip(F.col("a")).alias("a"), T.highlights(F.col("b"), F.lower("b")).alias("b"), a="\t x\r\n ", b="\tverify your account now\t\r\n")
    assert r.a == "x" and all(x == x.strip() for x in r.b)


def test_decoded_queries(spark):
    text = "https://a.example/?u=https%3A%2F%2Fevil.example%2Fx https://a.example/p"
    df = spark.createDataFrame([("m", "", text, "", "", "", "", ""), ("n", "", "no link", "", "", "", "", "")], MAIL)
    r, none = P.triage(df).orderBy("email_id").collect()
    assert r.url_signals[0].risk_flags == ["encoded-query", "nested-url-param", "query-redirect"] and r.url_signals[1].risk_flags == []
    assert (r.nested_urls, r.limits_hit, none.nested_urls, none.limits_hit) == (["https://evil.example/x"], [], [], [])
    assert r.raw_score > triaged(spark, text="https://a.example/ https://a.example/p").raw_score


def test_bounds_of_nested_urls(spark):
    link = lambda i: "https://a.example/?" + "&".join(f"u{j}=https%3A%2F%2Fe{i}-{j}.example" for j in range(9))
    df = spark.createDataFrame([("m", "", " ".join(map(link, range(3))) + " https://b.example/?" + "&".join(f"p{i}=1" for i in range(31)), "", "", "", "", "")], MAIL)
    r = P.triage(df).first()
    assert len(r.nested_urls) == 20 and r.limits_hit == ["url_query_param_cap_hit", "url_query_nested_url_cap_hit", "query_nested_url_cap_hit"]


def test_triage_of_parsed_messages(spark):
    eml = (
        "Subject: Hello\nFrom: a@bank.example\nReply-To: b@other.example\nAuthentication-Results: mx; spf=fail\nReceived: from localhost by mx\nMIME-Version: 1.0\n"
        'Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html\n\n<form></form><a href="https://evil.example/a">https://bank.example/login</a>\n'
        "--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename=\"setup.exe\"\n\nx\n--b--\n"
    )
    df = parse_messages(spark.createDataFrame([("e", eml), ("t", "hello team"), ("z", None)], "email_id string, raw string"))
    df = df.withColumn("parse_error", F.when(F.col("email_id") == "z", "ValueError: x"))
    e, t, z = P.triage_messages(df).orderBy("email_id").collect()
    assert set(e.urls) == {"https://evil.example/a", "https://bank.example/login"} and [f.filename for f in e.files] == ["setup.exe"]
    assert (e.header.spf, e.header.mismatch, e.header.received_patterns) == ("fail", True, ["localhost_received_hop"])
    assert {"contains_url", "contains_attachment", "html_active_content", "url_to_attachment_chain", "hidden_html_links"} <= set(e.indicators)
    assert (t.email_id, t.raw_score, t.verdict, t.urls) == ("t", 0, "benign", [])
    assert (z.risk_score, z.verdict, z.path, z.confidence, z.spam_score, z.indicators, z.labels.threat_tags) == (35, "phishing", "STANDARD", 0.35, 8, ["runtime:fallback_emergency"], ["fallback-error"])


def test_traffic_assessment(spark):
    scan = [("s", f"2024-01-01 00:00:{i % 60:02d}.{i:03d}", str(i), True) for i in range(128)]
    quiet = [("q", f"2024-01-01 00:0{i}:00", "443", False) for i in range(1, 9)]
    df = lambda rows: spark.createDataFrame(rows, "src string, at string, port string, syn boolean").withColumn("at", F.to_timestamp("at"))
    assert [(r.src, r.n, r.ports, round(r.entropy, 6), r.syn_ratio, r.scan) for r in X.port_scans(df(scan + quiet), "src", "port", "syn").orderBy("src").collect()] == [("q", 8, 1, 0.0, 0.0, False), ("s", 128, 128, 7.0, 1.0, True)]
    r = X.assess(df(scan + quiet), "src", "port", "syn", "at").first()
    assert (r.port_scan, r.dos, r.benign) == (True, False, False)
    assert X.assess(df(quiet), "src", "port", "syn", "at").first().asDict() == {"port_scan": False, "dos": False, "beaconing": True, "benign": False}
    assert X.assess(df([]), "src", "port", "syn", "at").first().benign


def test_null_texts_count_as_empty(spark):
    texts = ["subject", "text", "sender", "reply_to", "auth", "received", "attachment"]
    none = spark.createDataFrame([("m", *[None] * 7)], MAIL)
    empty = spark.createDataFrame([("m", *[""] * 7)], MAIL)
    assert P.triage(none).first() == P.triage(empty).first()
    said = spark.createDataFrame([("m", None, "See you at lunch.", None, None, None, None, None)], MAIL)
    assert (P.triage(said).first().raw_score, P.triage(said).first().urls) == (0, [])
    r = one(spark, *[c.alias(n) for c, n in zip(T.nlp_cues(*[F.lit(None).cast("string")] * 3), "abcdefghijk")])
    assert set(r[:7]) == {0.0} and T.CUES and texts


ADDRESSES = {
    "127.1": True, "2130706433": True, "0x7f.1": True, "0177.0.0.1": True, "8.8.8.8": False, "134744072": False, "010.8.8.8": False, "256.1.1.1": False, "1.2.3.4.5": False, "192.0.0.9": False, "192.0.0.8": True, "100.64.0.1": False,
    "::ffff:7f00:1": True, "::127.0.0.1": True, "64:ff9b::7f00:1": True, "2002:7f00:1::": True, "2001::1": True, "::2": True, "::": True, "fe80::1%eth0": True, "2606:4700::1111": False, "2001:4860:4860:0:0:0:0:8888": False, "2001:20::1": False,
    "1::2::3": False, "1:2:3:4:5:6:7": False, "fc00::1": True, "ff02::1": True, "localhost": True, "x.localhost": True, "example.org": False, "": False,
}


def test_addresses_that_are_not_public(spark):
    import ipaddress
    import random

    r = random.Random(3)
    known = dict(ADDRESSES)
    for start in ("2000::", "2001::", "2001:db8::", "2001:30::", "2002::", "fc00::", "fe80::", "100::", "400::", "5000::", "::ffff:0:0"):
        for bits in (8, 64, 100):
            ip = ipaddress.IPv6Address((int(ipaddress.IPv6Address(start)) + r.getrandbits(bits)) % (1 << 128))
            known[str(ip)] = known[ip.exploded] = ip.is_private or ip.is_reserved or ip.is_multicast or ip.is_unspecified
    for _ in range(200):
        ip = ipaddress.IPv4Address(r.getrandbits(32))
        known[str(ip)] = known[str(int(ip))] = ip.is_private or ip.is_reserved or ip.is_multicast
    rows = spark.createDataFrame([(h,) for h in known], "h string").select("h", U.private_address(F.col("h")).alias("p")).collect()
    assert {x.h: x.p for x in rows} == known
