"""Decoding by column expressions against the same a value at a time, and golden cases."""

import base64
import random

import plain_decoding as plain
import pytest
from pyspark.sql import functions as F

from mailgauge.functions import decode as D


def column(spark, values, made):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", made(F.col("v")).alias("r")).collect()
    return [r.r.asDict(recursive=True) if r.r is not None else None for r in sorted(rows, key=lambda r: r.i)]


def drawn(seed, pieces, n, most):
    r = random.Random(seed)
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_golden(spark):
    (layers,) = column(spark, ["Hello%20World&amp;test"], D.text_layers)
    assert layers == {"text": "Hello World&test", "steps": ["html_unescape", "percent_decode"], "percent": 1, "entities": 1, "input_truncated": False, "output_truncated": False}
    (coded,) = column(spark, ["aHR0cHM6Ly9ldmlsLmNvbS9sb2dpbg=="], D.base64_text)
    assert coded == {"kind": "base64", "status": "ok", "reason": None, "input_len": 32, "decoded_bytes": 22, "decoded_bytes_truncated": False, "text": "https://evil.com/login", "text_truncated": False, "printable_ratio": 1.0}
    (uri,) = column(spark, ["data:text/plain;base64,SGVsbG8gV29ybGQh"], D.data_uri)
    assert uri == {"status": "ok", "reason": None, "mime": "text/plain", "is_base64": True, "decoded_bytes": 12, "text": "Hello World!", "truncated": False}
    a, b, c = column(spark, ["https://tracker.example.com/?u=https%3A%2F%2Fevil.com%2Flogin", "https://tracker.example.com/?r=aHR0cHM6Ly9ldmlsLmNvbS9sb2dpbg==", "https://x.example/?long=" + "a" * 801 + "&k=%2541"], D.obfuscation)
    assert (a["params"], a["flags"], a["nested"]) == (1, ["nested_url_in_query", "percent_encoded_query"], ["https://evil.com/login"])
    assert (b["flags"], b["nested"], b["samples"][0]["base64"]["text"]) == (["base64_decoded_query_value"], ["https://evil.com/login"], "https://evil.com/login")
    assert [(s["key"], s["value_truncated"], len(s["value"]), s["text"][:3], s["steps"]) for s in c["samples"]] == [("long", True, 800, "aaa", []), ("k", False, 3, "A", ["percent_decode"])]


REFERENCES = [
    "&amp;", "&lt", "&copy;", "&copy", "&notit;", "&notin;", "&ampersand", "&bogus;", "&#65;", "&#65", "&#x41;", "&#X1F600;", "&#0;", "&#128;", "&#x9f;", "&#129;", "&#13;", "&#1;", "&#11;", "&#xD800;", "&#1114112;", "&#99999999999;",
    "&#xFFFE;", "&#x1FFFF;", "&#xFDD0;", "&#127;", "&", "&;", "&#;", "&#x;", "&CounterClockwiseContourIntegral;", "&NotEqualTilde;", "&Afr;", "a", " ", "é", "%", "%4", "%41", "%2525", "%C3%A9", "%E2%82", "%FF", "+", "%26amp%3B", "%0A", "\n", "<",
]


def test_text_layers(spark):
    values = [*REFERENCES, None, "", *drawn(1, REFERENCES, 600, 8), "%2541" * 3000, "&amp;" * 3000, "x" * 12_001]
    for v, got in zip(values, column(spark, values, D.text_layers)):
        want = plain.text_layers(v)
        assert (got["text"], got["steps"], got["percent"], got["entities"], got["input_truncated"]) == (want["text"], want["steps"], want["percent"], want["entities"], want["truncated"]), v


def test_base64_text(spark):
    r = random.Random(2)
    texts = [b"https://a.example/x?y=1", "é€ text of some length".encode(), bytes(range(256)), b" \t\n " * 6, b"\xff\xfe" * 20, b"a" * 700, b"\xe2\x82" + b"plain text here", "½ x  ​ y ".encode() * 3]
    values = [None, "", "short", "A" * 15, "A" * 16, "A" * 17, "A" * 18, "A" * 18 + "=", "A" * 18 + "==", "A" * 16 + "=", "A" * 19 + "==", "A" * 20 + "===", "A" * 4001, "A" * 50_001, "_-" * 10, "+_" * 10, "A=" * 10, " " + "QUJD" * 6 + "\n"]
    values += [c(t).decode() for t in texts for c in (base64.b64encode, base64.urlsafe_b64encode)] + [base64.b64encode(t).decode().rstrip("=") for t in texts]
    values += [base64.b64encode(r.randbytes(r.randint(12, 80))).decode()[: r.randint(14, 90)] for _ in range(150)]
    for v, got in zip(values, column(spark, values, D.base64_text)):
        want = plain.base64_text(v)
        assert (got and (got["kind"], got["status"], got["text"] or "")) == (want and (want["kind"], want["status"], want["text"])), v
        if want and want["status"] == "ok":
            assert got["printable_ratio"] == round(sum(map(str.isprintable, want["text"])) / len(want["text"]), 2), v


def test_data_uri(spark):
    r = random.Random(3)
    values = ["x", None, "data:", "DATA:,a%20b+c%zz", "data:text/plain;charset=x;base64,aGVsbG8=", "data:text/plain;base64,aGVs bG8", "data:image/png;base64,aGVsbG8=", "data:image/svg+xml;base64,PHN2Zz4=", "data:text/html;base64,a", "data:;base64,YQ==YQ==", "data:text/x;base64,Y=Q==", "data:text/x;base64,é", "data:text/plain," + "y" * 700, "data:," + "z" * 6000, "data:text/x;base64,====QUJD", "data: Text/Plain ;base64,QUI"]
    values += ["data:text/plain;base64," + "".join(r.choice("QUJD=+/ -") for _ in range(r.randint(0, 14))) for _ in range(200)]
    for v, got in zip(values, column(spark, values, D.data_uri)):
        want = plain.data_uri(v)
        assert (got and (got["status"], got["mime"] or "", got["is_base64"], got["text"])) == (want and (want["status"], want["mime"], want["is_base64"], want["text"])), v


HIDDEN = base64.b64encode(b"see <HTML> or https://deep.example/a and https://deep.example/b").decode()
QUERIES = ["a=1", "b", "&", "=", "u=https%3A%2F%2Fe.example%2F", "v=http://f.example/?x=1", "%41=%zz", "w=%2568ttps%3A//g.example", f"z={HIDDEN}", f"z={HIDDEN.rstrip('=')}", "q=a+b%20c", "e=&amp;x", "m=%26%23104%3Bttp://h.example", "s=%20HTTPS%3A%2F%2FI.Example%2F%20", "n=%FF%E2%82", "long=" + "a" * 790 + "%20https://cut.example", "é=ü"]


@pytest.mark.parametrize("seed", [5, 6])
def test_obfuscation(spark, seed):
    r = random.Random(seed)
    urls = [None, "", "no url", "https://a.example/p", "https://a.example/?", "http://[x/?a=%41", "http://[::1]:80/?a=%41", "https://a.example/#x?a=%41", " https://a.example/?a=%41\n", "https://a.example/?" + "&".join(f"u{j}=https%3A%2F%2Fe{j}.example" for j in range(12)), "https://a.example/?" + "&".join(f"p{i}=1" for i in range(31))]
    urls += ["https://a.example/x?" + "&".join(r.choice(QUERIES) for _ in range(r.randint(0, 6))) + r.choice(["", "#f?g=%41"]) for _ in range(150)]
    for u, got in zip(urls, column(spark, urls, D.obfuscation)):
        assert {k: got[k] for k in ("params", "flags", "nested")} == plain.obfuscation(u), u


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("x",)], "v string").select(D.obfuscation(F.col("v")).alias("o"), D.data_uri(F.col("v")).alias("d"), D.text_layers(F.col("v")).alias("l"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
