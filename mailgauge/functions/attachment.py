"""Attachment signals from names and bytes: built-in column expressions, but for members of archives."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgauge.functions import lexicon as L
from mailgauge.functions.text import keyword_hits
from mailgauge.functions.url import any_of, confidence, extract_urls


def suffix(name: Column) -> Column:
    """The last part of the file name from its last dot on, in lower case; none for a leading dot."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]+)$", 1))


def classify(name: Column) -> Column:
    low = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    ends = lambda xs: any_of([low.endswith(x) for x in xs])
    return F.when(low == "", "unknown").when(ends(L.HIGH_RISK), "high_risk").when(ends(L.MACROS), "macro_risk").otherwise("low_risk")


def name_risk(name: Column) -> Column:
    kind = classify(name)
    return F.when(kind == "low_risk", 8).when(kind == "macro_risk", 55).when(kind == "high_risk", 70).otherwise(10)


def mime_type(name: Column) -> Column:
    """The MIME type of a name's suffix by a fixed list, whatever the host's; empty for others."""
    known = F.create_map(*[F.lit(x) for pair in L.MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix(name)), F.lit(""))


def signal(name: Column) -> Column:
    """The signal of a file name: classes, flags in order and confidence."""
    end, kind = suffix(name), classify(name)
    archive, program = end.isin(*L.ARCHIVES), end.isin(*L.EXECUTABLES)
    macro = end.isin(*L.MACROS) | (kind == "macro_risk")
    flags = [("archive", archive), ("executable-like", program), ("macro-suspected", macro), ("high-risk-extension", kind == "high_risk")]
    risk = 8 + F.when(macro, 28).otherwise(0) + F.when(program, 24).otherwise(0) + F.when(archive, 10).otherwise(0)
    return F.struct(
        name.alias("filename"),
        kind.alias("class"),
        mime_type(name).alias("mime"),
        archive.alias("is_archive"),
        program.alias("is_executable_like"),
        macro.alias("macro_suspected"),
        F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in flags])).alias("risk_flags"),
        confidence(risk, 0.03).alias("confidence"),
    )


def extension_mismatch(name: Column, kind: Column) -> Column:
    end = suffix(name)
    wrong = [(kind == k) & ~end.isin(*ends) for k, ends in L.EXPECTED_SUFFIXES.items()]
    return (end != "") & any_of(wrong)


def magic_type(data: Column, name: Column) -> Column:
    """File type by its first bytes, else by its name."""
    h, end = F.lower(F.hex(F.substring(data, 1, 16))), suffix(name)
    starts = lambda *xs: any_of([h.startswith(x.hex()) for x in xs])
    text = F.ltrim(F.decode(F.substring(data, 1, 512), "ISO-8859-1"))
    out = F.when(starts(b"%PDF-"), "pdf").when(starts(b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"), "zip").when(starts(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), "ole")
    out = out.when(starts(b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a"), "image").when(starts(b"RIFF", b"ID3"), "audio")
    out = out.when(any_of([text.startswith(x) for x in ("<!doctype html", "<html", "<HTML", "<?xml")]), "html")
    for kind in ("pdf", "image", "audio", "zip", "ole", "html"):
        out = out.when(end.isin(*L.EXPECTED_SUFFIXES[kind]), kind)
    return out.otherwise("unknown")


def pdf_score(data: Column) -> Column:
    text = F.decode(data, "ISO-8859-1")
    low = F.lower(text)
    form = low.contains("/acform") | low.contains("/annots")
    points = keyword_hits(low, ("/javascript", "/js")) * 30 + F.when(form, 20).otherwise(0) + F.least(F.lit(20), F.size(extract_urls(text)) * 4)
    return F.least(F.lit(100), points)


def ole_score(data: Column) -> Column:
    return F.when(F.lower(F.decode(data, "ISO-8859-1")).contains("vba"), 40).otherwise(12)


def image_score(name: Column, ocr_text: Column, has_qr: Column) -> Column:
    low = F.lower(F.coalesce(ocr_text, F.lit("")))
    points = keyword_hits(F.lower(name), L.IMAGE_NAME_HINTS) * 6 + keyword_hits(low, L.IMAGE_TEXT_HINTS) * 14 + keyword_hits(low, L.IMAGE_BRANDS) * 8
    return F.least(F.lit(100), points + F.when(has_qr, 25).otherwise(0))


def audio_score(name: Column, transcript: Column) -> Column:
    low = F.lower(F.coalesce(transcript, F.lit("")))
    return F.least(F.lit(100), keyword_hits(F.lower(name), L.AUDIO_NAME_HINTS) * 10 + keyword_hits(low, L.AUDIO_TEXT_HINTS) * 15)


def html_score(impersonation: Column, url_count: Column) -> Column:
    return F.least(F.lit(100), (impersonation * 0.8).cast("int") + F.least(F.lit(20), url_count * 3))


def report(name: Column, data: Column, kind: Column, page_score: Column, zipped: Column, ocr_text: Column, qr_urls: Column, transcript: Column) -> Column:
    """The report of one attachment, a struct; ``data`` is null where only the name is known.

    ``kind`` is its magic_type, ``page_score`` the impersonation score of an HTML page, ``zipped`` a struct
    of risk_score and urls as archive_reports gives them; texts and codes found in pictures and recordings come as columns.
    """
    clean, none = F.trim(F.coalesce(name, F.lit(""))), F.array().cast("array<string>")
    base, risk = F.substring_index(clean, "/", -1), classify(name)
    text = F.decode(data, "ISO-8859-1")
    found = extract_urls(F.when(kind == "html", F.decode(data, "UTF-8")).otherwise(text))
    urls = F.when(kind.isin("pdf", "html", "unknown"), found).when(kind == "zip", zipped["urls"]).when(kind == "image", F.array_distinct(qr_urls))
    urls = F.when(data.isNotNull() & (clean != ""), F.coalesce(urls, none)).otherwise(none)
    deep = (
        F.when(kind == "pdf", pdf_score(data)).when(kind == "zip", zipped["risk_score"]).when(kind == "ole", ole_score(data)).when(kind == "html", html_score(page_score, F.size(found)))
        .when(kind == "image", image_score(base, ocr_text, F.size(qr_urls) > 0)).when(kind == "audio", audio_score(base, transcript)).otherwise(F.least(F.lit(40), F.size(found) * 8))
    )
    known = data.isNotNull()
    score = F.when(clean == "", 0).when(~known, name_risk(name)).otherwise(F.least(F.lit(100), F.greatest(name_risk(name), F.coalesce(deep, F.lit(0)))))
    tests = [
        ("empty_attachment_name", clean == ""),
        (F.concat(F.lit("filename_risk:"), risk), clean != ""),
        ("extension_high_risk", (clean != "") & ~known & risk.isin("high_risk", "macro_risk")),
        ("attachment_high_risk", known & (score >= 60)),
        ("attachment_contains_url", F.size(urls) > 0),
        ("social_engineering_filename", known & clean.rlike("(?i)invoice|payment|login|verify")),
    ]
    return F.struct(
        clean.alias("name"),
        F.when(clean == "", "unknown").when(~known, "filename_only").otherwise(kind).alias("type"),
        score.alias("risk_score"),
        F.array_compact(F.array(*[F.when(t, n if isinstance(n, Column) else F.lit(n)) for n, t in tests])).alias("indicators"),
        urls.alias("extracted_urls"),
    )
