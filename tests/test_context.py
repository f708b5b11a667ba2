"""Attachments with bytes, judge context, references, stages, packs and checks of requests against values worked out by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from mailgauge.functions import attachment as A
from mailgauge.functions import url as U
from mailgauge.operators import context as C
from mailgauge.operators import evidence as E
from mailgauge.operators import stages as G
from mailgauge.operators import verdict as V
from mailgauge.plans import triage as P
from mailgauge.sources import tables
from mailgauge.sources import packs
from mailgauge.sources.messages import sanitize

MAIL = "email_id string, subject string, text string, sender string, reply_to string, auth string, received string, attachment string"


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_", "."), text)
    return out.getvalue()


def test_reports(spark):
    rows = [("a.docm", archive(word__vbaProject_bin="x")), ("", b"x"), (None, None), ("run.exe", None), ("n.bin", b"see https://a.example/1 https://a.example/2"), ("p.pdf", b"%PDF-1.4 /JavaScript"), ("login.html", b"<html>https://b.example/</html>")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, name string, data binary").withColumn("kind", A.magic_type(F.col("data"), F.col("name")))
    zipped = tables.archive_reports(tables.archive_members(df.select(F.col("name").alias("file"), "data").where("name = 'a.docm'")), "file").select(F.col("file").alias("name"), F.struct("risk_score", "urls").alias("z"))
    df = df.join(zipped, "name", "left").orderBy("i")
    r = [x.r for x in df.select(A.report(F.col("name"), F.col("data"), F.col("kind"), F.lit(50), F.col("z"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(None).cast("string")).alias("r")).collect()]
    assert [(x.type, x.risk_score) for x in r] == [("zip", 55), ("unknown", 0), ("unknown", 0), ("filename_only", 70), ("unknown", 16), ("pdf", 30), ("html", 43)]
    assert r[1].indicators == ["empty_attachment_name"] and r[3].indicators == ["filename_risk:high_risk", "extension_high_risk"]
    assert r[4].extracted_urls == ["https://a.example/1", "https://a.example/2"] and "attachment_contains_url" in r[4].indicators
    assert r[5].indicators == ["filename_risk:low_risk"] and r[6].indicators[-1] == "social_engineering_filename"


def test_last_report_of_a_name_counts(spark):
    s = spark.createDataFrame([("m", "x.pdf", ["archive"], 0.5), ("m", "y", [], 0.5)], "email_id string, name string, risk_flags array<string>, confidence double")
    r = spark.createDataFrame([("m", 0, "x.pdf", "pdf", 9, False, []), ("m", 1, "x.pdf", "ole", 40, True, ["https://a.b"])], "email_id string, pos int, name string, type string, risk_score int, macro_like boolean, extracted_urls array<string>")
    x, y = E.enriched_flags(E.enrich_attachments(s, r)).orderBy("name").collect()
    assert (x.extension_mismatch, x.risk_flags, x.confidence) == (True, ["archive", "extension-mismatch", "macro-suspected", "attachment-url-chain"], 0.64)
    assert (y.extension_mismatch, y.risk_flags, y.confidence) == (False, [], 0.5)


@pytest.mark.parametrize(("url", "want"), [("http://10.1.2.3/x", "private_network_blocked"), ("http://172.32.0.1", None), ("http://172.31.0.1", "private_network_blocked"), ("http://8.8.8.8:80", None), ("ftp://a.b", "unsupported_scheme"), ("http:///x", "missing_host"), ("http://300.1.1.1", None), ("https://a.example", None)])
def test_fetch_refusal(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(U.fetch_refusal(F.col("u"))).first()[0] == want


def test_input_errors(spark):
    raws = [None, "", "{broken}", '{"eml_path": "x"}', '{"attachments": 3}', '{"attachments": ["a"]}', '{"attachments": [{"name": "a"}, {"name": "b/c"}, {}]}', '{"attachments": [{}, {"name": "b/c"}]}', '{"attachments": []}', '["x"]']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raws], "raw string").select(V.input_error(F.col("raw"))).collect()]
    assert got == [None, None, None, "unsupported_eml_path", "invalid_attachment_schema", "invalid_attachment_schema", "unsafe_attachment_path", "invalid_attachment_schema", None, None]


def triaged(spark, text, attachment=""):
    return P.triage(spark.createDataFrame([("m", "Notice", text, "a@b.example", "", "", "", attachment)], MAIL))


def test_context_keeps_to_the_budget(spark):
    text = " ".join(f"https://h{i}.example/login?n={i}" for i in range(9))
    r = C.with_refs(C.judge_context(triaged(spark, text, "a.exe"))).first()
    assert (r.path, len(r.selected_url_signals), len(r.selected_domain_reports), len(r.selected_attachment_signals)) == ("DEEP", 6, 5, 1)
    assert [x.evidence_id for x in r.evidence_refs] == [f"evd_{i:04d}" for i in range(1, 18)]
    assert [x.evidence_path for x in r.evidence_refs][5:12:6] == ["selected_url_signals[0]", "selected_attachment_signals[0]"]
    assert r.email_context.urls_count == 9 and r.precheck_summary.combined_url_count == 9


def test_equal_evidence_has_one_number(spark):
    t = triaged(spark, "hello").withColumn("web_signals", F.array(*[F.struct(F.lit(5).alias("risk"), F.array(F.lit("x")).alias("risk_flags"), F.lit(0.5).alias("confidence"))] * 2)).withColumn("path", F.lit("DEEP"))
    r = C.with_refs(C.judge_context(t)).first()
    assert [x.evidence_id for x in r.evidence_refs][-2:] == ["evd_0006", "evd_0006"]


def test_old_paths_resolve(spark):
    df = spark.createDataFrame([("url_signals[0].x",), ("url_signals",), ("url_signalsx",), (" web_signals.a ",), (None,)], "p string")
    assert [r[0] for r in df.select(C.current_path(F.col("p"))).collect()] == ["selected_url_signals[0].x", "selected_url_signals", "url_signalsx", "selected_web_signals.a", ""]


def test_registry_of_stages(spark):
    s = G.Stages(frozenset({"a", "b"}))
    s.register("a", lambda df: df.withColumn("x", F.lit(1)), "one")
    for bad in (("a", 5), ("c", 5), ("", 5), ("b", 6), ("b", 0)):
        with pytest.raises(ValueError):
            s.register(bad[0], lambda df: df, steps=bad[1])
    assert s.chain(spark.range(1)).columns == ["id", "x"] and s.describe() == {"a": "one"}
    with pytest.raises(G.UnknownStage):
        s.run("b", spark.range(1))


def test_chain_with_urls_of_attachments(spark):
    m = spark.createDataFrame([("m", "Notice", "see https://bit.ly/reset", "", "", "", "", "")], MAIL)
    plain = G.fixed_chain().chain(m).first()
    deep = G.fixed_chain().chain(m.withColumn("attachment_urls", F.array(F.lit("https://bit.ly/reset")))).first()
    assert len(G.fixed_chain().names()) == 8 and plain.pre_score.risk_score == 44
    assert [len(x.url_signals) for x in (plain, deep)] == [1, 2] and deep.pre_score.risk_score > plain.pre_score.risk_score
    assert deep.url_signals[1].risk_flags[-1] == "nested_url_in_attachment"


def test_tools(spark):
    df = spark.createDataFrame([("Verify  the\nINVOICE at https://Bit.ly/x", "https://bit.ly/x", "a.exe")], "t string, u string, n string")
    r = df.select(G.tool("normalize_text", F.col("t")), G.tool("keyword_scan", F.col("t")), G.tool("extract_urls", F.col("t")), G.tool("check_url", F.col("u")), G.tool("attachment_risk", F.col("n")), G.tool("domain_intel", F.col("u")), G.tool("route_path", F.col("t"), F.array("u"), F.array("n"))).first()
    assert r[0] == "Verify the INVOICE at https://Bit.ly/x" and (r[1].matches, r[1]["count"]) == (["verify", "invoice"], 2)
    assert r[2].urls == ["https://bit.ly/x"] and r[3].suspicious and r[4].risk == "high_risk" and r[5].base_domain == "bit.ly" and r[6] == "DEEP"
    with pytest.raises(G.UnknownStage):
        G.tool("other")


def test_pages_raise_the_score(spark):
    m = spark.createDataFrame([("m", "Notice", "https://bit.ly/reset", "", "", "", "", "")], MAIL)
    w = spark.createDataFrame([("m", [(60, ["credential-harvest"], 0.7)])], "email_id string, web_signals array<struct<risk:int,risk_flags:array<string>,confidence:double>>")
    plain, seen = P.triage(m).first(), P.triage(m, w, fetch=True).first()
    assert seen.raw_score > plain.raw_score and seen.web_admission.status == "admitted"


def test_packs(spark, tmp_path):
    for name, text in {"one": '---\nname: "First"\n# no\ndescription: it: does\nname: \'Last\'\n---\nbody', "two": "no front matter", "three": "---\ndescription: x\n---"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(text)
    got = {r.name: r.description for r in packs.read_packs(spark, str(tmp_path)).collect()}
    assert got == {"Last": "it: does", "two": "", "three": "x"}
    asked = spark.createDataFrame([("two",), ("four",), ("four",)], "name string")
    assert [r.name for r in packs.missing(asked, packs.read_packs(spark, str(tmp_path))).collect()] == ["four"]


def test_best_paths(spark):
    at = "/environment/skills/"
    paths = [f"other/a{at}p/SKILL.md", f"tasks/b/c{at}p/SKILL.md", f"tasks/b{at}p/SKILL.md", f"tasks/a{at}p/SKILL.md", f"tasks/a{at}q/readme", f"tasks-no-skills/a{at}r/SKILL.md", "tasks/a/skills/s/SKILL.md"]
    got = {r.name: r.path for r in packs.best_paths(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"p": f"tasks/a{at}p", "r": f"tasks-no-skills/a{at}r"}


def test_private_fields_go(spark):
    report = "array<struct<name:string,exists:boolean,sha256:string,details:string>>"
    df = spark.createDataFrame([(1, [("a", True, "x", "y")], [("u", ("ok", "e", "c"))], "z")], f"id int, attachment_reports {report}, url_target_reports array<struct<url:string,fetch:struct<status:string,stderr:string,command:string>>>, evidence string")
    r = sanitize(df).first().asDict(True)
    assert r == {"id": 1, "attachment_reports": [{"name": "a"}], "url_target_reports": [{"url": "u", "fetch": {"status": "ok"}}]}


def test_balanced_sample_and_metrics_of_nothing(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    s = E.balanced_sample(df, "id", "y", 15, "s")
    assert {r.y: r["count"] for r in s.groupBy("y").count().collect()} == {0: 15, 1: 10} and s.subtract(E.balanced_sample(df, "id", "y", 15, "s")).count() == 0
    none = spark.createDataFrame([], "predicted string, truth string, risk_score int, provider string")
    r = E.run_metrics(none).first()
    assert (r.total, r.specificity, r.mean_risk, r.fallback_rate) == (0, 0.0, 0.0, 0.0)


def test_context_items_carry_their_number(spark):
    r = C.with_refs(C.judge_context(triaged(spark, "https://bit.ly/reset https://bit.ly/reset2", "a.exe"))).first()
    known = {x.evidence_path: x.evidence_id for x in r.evidence_refs}
    items = {x.evidence_path: x.evidence_id for x in [*r.selected_url_signals, *r.selected_attachment_signals, r.pre_score, r.nlp_summary]}
    assert {"selected_url_signals[0]", "selected_url_signals[1]", "selected_attachment_signals[0]", "pre_score", "nlp_summary"} == set(items)
    assert all(known[k] == v for k, v in items.items())


def test_tools_of_messages_and_files(spark):
    df = spark.createDataFrame([("Subject: x\nFrom: a@b.example\n\nhello", ["setup.exe", "notes.txt"])], "raw string, names array<string>")
    r = df.select(G.tool("parse_email", F.col("raw")).alias("m"), G.tool("attachments_deep", F.col("names")).alias("d")).first()
    assert (r.m.subject, r.m.sender, r.m.parse_error) == ("x", "a@b.example", None)
    assert [x.name for x in r.d] == ["setup.exe", "notes.txt"] and r.d[0].risk_score > r.d[1].risk_score
