"""Redaction inside JSON documents."""

import json

from pyspark.sql import functions as F

from mailgauge.functions.redact import redact_json


def test_strings_at_any_depth(spark):
    doc = {"to": ["john.doe@example.com", 7, None], "deep": {"u": "https://x.y/p?token=abc&q=1&code=#f", "k": "k" * 31, "ok": True}}
    rows = [(json.dumps(doc),), ("plain john.doe@example.com",), ("",), (None,), ("[" * 5000,), ('"http://[bad"',)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(redact_json(F.col("j"))).collect()]
    want = {"to": ["jo***@example.com", 7, None], "deep": {"u": "https://x.y/p?token=%3Credacted%3Aba7816bf8f01%3E&q=1&code=%3Credacted%3E", "k": "<redacted-token>", "ok": True}}
    assert json.loads(got[0]) == want
    assert got[1:4] == ["plain jo***@example.com", "", None] and got[4] == "[" * 5000 and got[5] == '"http://[bad"'
