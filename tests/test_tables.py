"""Table functions: parts, members and links, hostile ones among them."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from mailgauge.sources import tables


def archive(members, **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, **options) as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def reports(spark, *files):
    rows = [(i, bytearray(f) if f is not None else None) for i, f in enumerate(files)]
    members = tables.archive_members(spark.createDataFrame(rows, "i int, data binary"))
    return {r.i: r for r in tables.archive_reports(members, "i").collect()}, members


def test_members(spark):
    office = archive([("word/vbaProject.bin", "x"), ("word/document.xml", "<a>https://A.example/x</a> https://a.example/x https://b.example"), ("a.txt", "https://not.read")])
    got, members = reports(spark, office, None, b"", b"PK\x03\x04broken", archive([]), archive([("x.rels", "é" * 10)]))
    assert set(got) == {0, 5} and members.columns == ["i", "member", "name", "size", "packed", "text", "skipped"]
    r = got[0]
    assert (r.members, r.macro_like, r.entries, r.urls, r.skipped, r.risk_score) == (3, True, ["word/vbaProject.bin"], ["https://a.example/x", "https://b.example"], [], 48)


def test_hostile_archives(spark):
    bomb = archive([("big.xml", b"0" * (tables.MOST_PART + 1)), ("ok.xml", "https://a.example")])
    many = archive([(f"{i}.xml", b"1" * 3_900_000) for i in range(6)])
    lying = bytearray(archive([("a.xml", "y" * 5000)]))
    at = lying.rindex(b"PK\x01\x02")
    lying[at + 24 : at + 28] = (10).to_bytes(4, "little")
    cut = archive([("a.xml", "z" * 100_000)])
    twice = io.BytesIO()
    with zipfile.ZipFile(twice, "w") as z, pytest.warns(UserWarning):
        z.writestr("a.xml", "https://one.example")
        z.writestr("a.xml", "https://two.example")
    locked = bytearray(archive([("a.xml", "secret")]))
    for mark, place in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + place] |= 1
    got, members = reports(spark, bomb, many, lying, cut[: len(cut) // 2], twice.getvalue(), locked)
    assert (got[0].skipped, got[0].urls, got[0].risk_score) == (["big.xml"], ["https://a.example"], 4 + tables.UNSEEN)
    assert len(got[1].skipped) == 2 and got[1].risk_score == tables.UNSEEN
    assert got[2].skipped == ["a.xml"] and 3 not in got and got[4].urls == ["https://one.example", "https://two.example"] and got[5].skipped == ["a.xml"]
    assert members.agg(F.max(F.length("text"))).first()[0] <= tables.MOST_PART


def test_nested_parts(spark):
    deep = "Subject: s\n"
    for i in range(60):
        deep += f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n"
    deep += "Content-Type: text/plain\n\ninnermost\n"
    forwarded = "Subject: f\nContent-Type: message/rfc822\n\nSubject: inner\nContent-Type: multipart/alternative; boundary=x\n\n--x\nContent-Type: text/plain\n\nplain\n--x\nContent-Type: text/html; charset=no-such\n\n<b>html</b>\n--x--\n"
    large = "Subject: l\nContent-Type: application/zip; name=big.zip\nContent-Transfer-Encoding: base64\n\n" + "QUJD" * 1_400_000
    broken = "Subject: b\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\n@@@@"
    rows = [(1, deep), (2, forwarded), (3, large), (4, broken), (5, "just text"), (6, ""), (7, None)]
    got = {}
    for r in tables.mime_parts(spark.createDataFrame(rows, "i int, raw string")).orderBy("i", "part").collect():
        got.setdefault(r.i, []).append(r)
    assert [(r.depth, r.text.strip()) for r in got[1]] == [(60, "innermost")]
    assert [(r.part, r.depth, r.content_type, r.text.strip()) for r in got[2]] == [(0, 2, "text/plain", "plain"), (1, 2, "text/html", "<b>html</b>")]
    assert (got[3][0].name, got[3][0].skipped, got[3][0].text) == ("big.zip", "over the bound", None)
    assert got[4][0].skipped is None and got[5][0].text == "just text" and set(got) == {1, 2, 3, 4, 5}


def test_very_deep_parts_are_a_row(spark):
    deep = "Subject: s\n" + "".join(f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n" for i in range(3000)) + "\nx"
    assert tables.mime_parts(spark.createDataFrame([(1, deep)], "i int, raw string")).count() == 1


def test_links(spark):
    html = '<a href=" https://evil.example/a">go to <b>https://bank.example/login</b></a><a name=x>no</a><a href="//Bank.example/p">http://bank.example/q</a><a href="/local">https://bank.example</a><a href=x>&lt;</a><a href="https://open.example">never closed'
    df = spark.createDataFrame([(1, html), (2, None), (3, "no links")], "page_id int, html string")
    rows = tables.anchors(df).withColumn("hides", tables.hides_target(F.col("href"), F.col("shown"))).orderBy("pos").collect()
    assert [(r.pos, r.href, r.shown, r.hides) for r in rows] == [
        (0, "https://evil.example/a", "go to https://bank.example/login", True), (1, "//Bank.example/p", "http://bank.example/q", False), (2, "/local", "https://bank.example", True), (3, "x", "<", False),
    ]


def test_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "a", 5, bytearray(archive([("m.txt", "x")])))], "i int, name string, size int, data binary")
    assert [r.asDict() for r in tables.archive_members(df).collect()] == [{"i": 1, "member": 0, "name": "m.txt", "size": 1, "packed": 3, "text": None, "skipped": None}]
