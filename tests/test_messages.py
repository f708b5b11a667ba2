"""Messages by column expressions against the parser, paths over VARIANT columns, and whole tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mailgauge.sources import messages, plain

JSONS = [
    {}, {"subject": " s ", "text": "see https://A.example/x"}, {"subject": 5, "sender": None, "text": " "}, {"to": ["a@b.c", " a@b.c ", 3, ""], "cc": "x@y.z"}, {"urls": [" https://u.example ", 7, "", None, True, "https://u.example"]},
    {"attachments": ["a.pdf", " a.pdf", {"name": "b.doc"}, {"filename": "c.js"}, {"name": "", "filename": " d "}, {"name": 0, "filename": "e"}, {"name": 12}, [], 4, None, ["x"], {"name": True}, {}]}, {"attachments": "a.pdf"}, {"attachments": {"name": "x"}},
    {"headers": {"X-B": "2", "a": "1", "x-b": "3", "n": 5, "t": True, "z": None}, "body_text": "see http://b.example/?"}, {"headers": []}, {"body_html": "<b>https://h.example/</b>", "body_text": "t", "date": " d"}, {"a": {"b": [1, {"c": "é"}]}},
    {"subject": "x\ny", "text": "line one\nhttps://one.example\n"}, {"eml": 5, "eml_raw": " ", "text": "no eml"},
]
TEXTS = [
    None, "", "  \n ", "plain  text\twith https://p.example/a?", "{broken}", "{}", "{\"a\": 1", "[1]", "{1}", "Subject: a\nbody", "Subject: a\n\nbody\n more", "\n \nSUBJECT : a\r\nFrom: b <b@c.de>\r\nTo: d@e.fg, F <f@g.hi>\r\nX-Other: no\r\nrest",
    "From: a\nTo: b@c.de\n\nno subject", "Date: a\n\nSubject: late", "Subject: first\nsubject: second\nCc: a@b.cd,, a@b.cd\n\nbody https://body.example", "Subject:\n\n", "subject: x", "no header: here\nSubject: y", "Subject: a\n : b\n", "Subject: q\n \nbody",
]


def column(spark, raws, made):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", made(F.col("raw")).alias("m")).collect()
    return [r.m for r in sorted(rows, key=lambda r: r.i)]


def test_plain_messages_equal_the_parser(spark):
    r = random.Random(1)
    raws = [*TEXTS, *map(json.dumps, JSONS), " " + json.dumps(JSONS[1], indent=1) + "\n"]
    lines = ["Subject: s", "From: A <a@b.cd>", "To: x@y.zz", "Date:  d ", "", " ", "body http://t.example", "Message-ID: <1@2>", "{", "Other: z"]
    raws += ["\n".join(r.choice(lines) for _ in range(r.randint(1, 6))) for _ in range(250)]
    odd = column(spark, raws, plain.needs_parser)
    for raw, asked, got in zip(raws, odd, column(spark, raws, plain.plain_message)):
        if asked:
            assert messages.looks_like_eml(raw) or "eml" in raw
            continue
        want = messages.parse(raw)
        assert got.asDict() == want, raw


@pytest.mark.parametrize(("raw", "odd"), [('{"eml": "Subject: a"}', True), ('{"body_html": "<A href=x>"}', True), ("Subject: a\nTo: \"x, y\" <a@b.cd>\n\n", True), ("Subject: a\nTo: a@b.cd (c)\n\n", True), ("Subject: a\nFrom: b\n\nx", True), ("Subject: a\nTo: A B <a@b.cd>, c@d.ef\nbody", False)])
def test_what_needs_the_parser(spark, raw, odd):
    assert column(spark, [raw], plain.needs_parser) == [odd]


def test_long_header_block(spark):
    raw = "Subject: a\n" + "Cc: a@b.cd\n" * 50_000 + "\nbody"
    (got,) = column(spark, [raw], plain.plain_message)
    assert (got.subject, got.cc, got.body_text) == ("a", ["a@b.cd"], "body")


def test_messages_by_path(spark):
    eml = "Subject: From file\nFrom: a@b.cd\n\nsee https://file.example/x"
    rows = [(1, json.dumps({"eml_path": " m/1.eml ", "sender": "own@c.de"})), (2, json.dumps({"eml_path": "m/none.eml", "text": "t"})), (3, json.dumps({"eml_path": "m/1.eml", "eml": "Subject: Embedded\nTo: x@y.zz\n\nb"})), (4, "plain")]
    df, files = spark.createDataFrame(rows, "email_id int, raw string"), spark.createDataFrame([("m/1.eml", eml), ("m/2.eml", "x")], "path string, raw string")
    got = {r.email_id: r for r in messages.parse_messages(df, files=files).collect()}
    assert (got[1].subject, got[1].sender, got[1].urls) == ("From file", "own@c.de", ["https://file.example/x"])
    assert (got[2].text, got[2].subject, got[3].subject, got[4].format) == ("t", "", "Embedded", "text")
    assert messages.parse_messages(df).where("email_id = 1").first().subject == ""


def test_paths(spark):
    v = json.dumps({"url_signals": [{"risk_flags": ["a", "b"], "url": "u"}], "n": {"deep": [[1, {"x": None}]]}, "t": True})
    want = {"url_signals[0].risk_flags": '["a","b"]', "url_signals[0].risk_flags[1]": '"b"', "url_signals[1]": None, "n.deep[0][1]": '{"x":null}', "n.deep[0][0]": "1", "t": "true", "n.none": None, "": None, "a b": None, "n..deep": None, "$.n": None, "n[": None}
    df = spark.createDataFrame([(p,) for p in want] + [(None,)], "path string")
    rows = df.select("path", F.to_json(plain.value_at(F.parse_json(F.lit(v)), F.col("path"))).alias("v")).collect()
    assert {r.path: r.v for r in rows} == want | {None: None}


def test_no_python_for_plain_messages(spark):
    df = spark.createDataFrame([("x",)], "raw string").select(plain.plain_message(F.col("raw")).alias("m"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
