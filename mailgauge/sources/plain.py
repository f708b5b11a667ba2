"""JSON, header-block and plain messages to the e-mail schema, as column expressions: VARIANT for JSON, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgauge.functions.text import WHITE, bind, normalize, strip
from mailgauge.functions.url import extract_urls

#: The e-mail schema: texts, lists and maps of texts.
TEXTS = ("message_id", "date", "sender", "reply_to", "return_path", "subject", "text", "body_text", "body_html", "headers_raw", "format")
LISTS = ("to", "cc", "urls", "attachments")
MAPS = ("headers", "attachment_hashes")
SCHEMA = "struct<" + ",".join([*(f"{n}:string" for n in TEXTS), *(f"{n}:array<string>" for n in LISTS), *(f"{n}:map<string,string>" for n in MAPS), "parse_error:string"]) + ">"
#: Header lines of a header block and the columns they fill.
HEADER_KEYS = {"subject": "subject", "from": "sender", "to": "to", "cc": "cc", "reply-to": "reply_to", "return-path": "return_path", "date": "date", "message-id": "message_id"}
#: A header block: blank lines, then known header lines. Repeats don't give back, so that long blocks need no stack.
_BLOCK = r"(?i)\A(?:[\s&&[^\n]]*\n)*+((?:[\s&&[^\n]]*(?:" + "|".join(HEADER_KEYS) + r")[\s&&[^\n]]*:[^\n]*+(?:\n|\z))++)"
#: One plain address of a list, named or not; anything else is left to the parser of MIME messages.
_ADDRESS = r"\A\s*(?:[^<>@,\"()\\:;\[\]]*<([^<>\s@,\"()\\:;\[\]]+@[^<>\s@,\"()\\:;\[\]]+)>|([^<>\s@,\"()\\:;\[\]]+@[^<>\s@,\"()\\:;\[\]]+)|)\s*\z"


def _none() -> Column:
    return F.array().cast("array<string>")


def _no_map() -> Column:
    return F.create_map().cast("map<string,string>")


def _message(**known: Column) -> Column:
    """The schema's struct with ``known`` fields, the others empty; text falls back to the bodies."""
    fields = {n: F.lit("") for n in TEXTS} | {n: _none() for n in LISTS} | {n: _no_map() for n in MAPS} | {"parse_error": F.lit(None).cast("string")} | known
    either = F.when(fields["text"] != "", fields["text"]).when(fields["body_text"] != "", fields["body_text"]).otherwise(fields["body_html"])
    return F.struct(*[c.alias(n) for n, c in (fields | {"text": either}).items()]).cast(SCHEMA)


def _listed(items: Column) -> Column:
    """Texts without white space around them, empty ones and repeats left out."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != ""))


# JSON -------------------------------------------------------------------------------------------------------------


def json_object(raw: Column) -> Column:
    """The VARIANT of a text that is a JSON object, else null."""
    text = strip(raw)
    return F.when(text.startswith("{") & text.endswith("}"), bind(F.try_parse_json(text), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)))


def kind_at(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))


def string_at(v: Column, path: str) -> Column:
    """The string at a path, empty where there is none, something else or only white space."""
    return F.when((kind_at(v, path) == "STRING") & (strip(F.try_variant_get(v, path, "string")) != ""), F.try_variant_get(v, path, "string")).otherwise("")


def list_at(v: Column, path: str) -> Column:
    """The VARIANTs of a list, null for anything else."""
    return F.when(kind_at(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def shown(item: Column) -> Column:
    """A JSON value as text: strings as they are, null as None, truth values capitalised, other values as JSON."""
    kind = F.coalesce(F.schema_of_variant(item), F.lit("VOID"))
    return F.when(kind == "STRING", F.try_variant_get(item, "$", "string")).when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(F.to_json(item))).otherwise(F.to_json(item))


def attachment_name(item: Column) -> Column:
    """The name of one item of a list of attachments: a string itself, of an object the first of name and filename that says something."""
    said = lambda path: F.when(kind_at(item, path) == "STRING", F.try_variant_get(item, path, "string")).when(kind_at(item, path).isin("", "VOID") | F.to_json(F.try_variant_get(item, path, "variant")).isin("0", "false", "[]", "{}"), "").otherwise(shown(F.try_variant_get(item, path, "variant")))
    kind = F.schema_of_variant(item)
    named = bind(said("$.name"), lambda n: F.when(n != "", n).otherwise(said("$.filename")))
    return strip(F.when(kind == "STRING", F.try_variant_get(item, "$", "string")).when(kind.startswith("OBJECT"), named).otherwise(""))


def _merged(entries: Column) -> Column:
    """A map of entries whose keys, in lower case, keep their first place and their last value."""
    low = lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))

    def whole(e: Column) -> Column:
        keys = F.array_distinct(F.transform(e, lambda x: x["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(e, lambda x: x["key"] == k), -1)["value"]))

    return bind(F.transform(entries, low), whole)


def _lines(headers: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def of_json(raw: Column, v: Column) -> Column:
    """The message of a JSON object without an embedded one; fields of another type than theirs count as missing."""
    texts = {n: strip(string_at(v, f"$.{n}")) for n in ("subject", "sender", "reply_to", "return_path", "message_id", "date")}
    bodies = {n: string_at(v, f"$.{n}") for n in ("body_html", "body_text", "text")}
    none = F.array().cast("array<variant>")
    people = {n: _listed(F.transform(F.filter(F.coalesce(list_at(v, f"$.{n}"), none), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))) for n in ("to", "cc")}
    given = F.transform(F.coalesce(list_at(v, "$.urls"), none), lambda x: strip(shown(x)))
    files = _listed(F.transform(F.coalesce(list_at(v, "$.attachments"), none), attachment_name))
    # VARIANT sorts an object's keys; the header lines keep the order they were written in.
    headers = F.from_json(F.get_json_object(strip(raw), "$.headers"), "map<string,variant>", {"mode": "PERMISSIVE"})
    headers = F.when(kind_at(v, "$.headers").startswith("OBJECT"), _merged(F.transform(F.map_entries(headers), lambda e: F.struct(e["key"].alias("key"), shown(e["value"]).alias("value"))))).otherwise(_no_map())
    urls = lambda b: F.array_distinct(F.filter(F.concat(extract_urls(b["body_html"]), extract_urls(b["body_text"]), extract_urls(b["text"]), given), lambda u: u != ""))
    both = F.struct(F.struct(*[c.alias(n) for n, c in bodies.items()]).alias("b"), headers.alias("h"))
    return bind(both, lambda x: _message(format=F.lit("json"), **texts, **{n: x["b"][n] for n in bodies}, **people, urls=urls(x["b"]), attachments=files, headers=x["h"], headers_raw=_lines(x["h"])))


# Header blocks and the rest ---------------------------------------------------------------------------------------


def looks_like_eml(raw: Column) -> Column:
    text = F.ltrim(F.replace(raw, F.lit("\r\n"), F.lit("\n")), F.lit(WHITE))
    return text.contains("\n\n") & bind(F.lower(F.substring_index(text, "\n\n", 1)), lambda head: head.contains("subject:") & (head.contains("from:") | head.contains("to:")))


def header_block(raw: Column) -> Column:
    """The lines of known headers at the start of a message, empty without any or without a subject."""
    return bind(F.regexp_extract(F.replace(raw, F.lit("\r\n"), F.lit("\n")), _BLOCK, 1), lambda b: F.when(b.rlike(r"(?im)^\s*subject\s*:"), b).otherwise(""))


def _header_pairs(block: Column) -> Column:
    line = lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("value"))
    return _merged(F.transform(F.filter(F.split(block, "\n"), lambda x: x.contains(":")), line))


def _addresses(value: Column) -> Column:
    one = lambda x: F.concat(F.regexp_extract(x, _ADDRESS, 1), F.regexp_extract(x, _ADDRESS, 2))
    return _listed(F.transform(F.split(value, ","), one))


def _odd_addresses(headers: Column) -> Column:
    odd = lambda k: F.exists(F.split(F.coalesce(headers[k], F.lit("")), ","), lambda x: ~x.rlike(_ADDRESS))
    return odd("to") | odd("cc")


def of_header_block(raw: Column, block: Column) -> Column:
    whole = F.replace(raw, F.lit("\r\n"), F.lit("\n"))

    def out(h: Column, body: Column) -> Column:
        fields = {name: _addresses(F.coalesce(h[key], F.lit(""))) if name in LISTS else F.coalesce(h[key], F.lit("")) for key, name in HEADER_KEYS.items()}
        return _message(format=F.lit("header_block"), **fields, headers=h, headers_raw=_lines(h), text=strip(raw), body_text=body, urls=extract_urls(F.concat(strip(raw), F.lit("\n"), body)))

    return bind(_header_pairs(block), lambda h: bind(strip(F.regexp_replace(whole, _BLOCK, "")), lambda body: out(h, body)))


def of_text(raw: Column) -> Column:
    return bind(normalize(strip(raw)), lambda t: _message(format=F.when(t == "", "empty").otherwise("text"), text=t, urls=extract_urls(t)))


def _by_format(raw: Column, json: Callable[[Column], Column], eml: Column, block: Callable[[Column], Column], text: Column) -> Column:
    """One of four results by a message's format."""
    other = bind(header_block(raw), lambda b: F.when(looks_like_eml(raw), eml).when(b != "", block(b)).otherwise(text))
    return bind(json_object(raw), lambda v: F.when(v.isNotNull(), json(v)).otherwise(other))


def needs_parser(raw: Column) -> Column:
    """Whether a message has MIME parts, links in HTML or addresses that only a parser in Python reads."""
    raw = F.coalesce(raw, F.lit(""))
    wrapped = lambda v: (string_at(v, "$.eml") != "") | (string_at(v, "$.eml_raw") != "") | (string_at(v, "$.eml_path") != "") | F.lower(string_at(v, "$.body_html")).rlike(r"<a[\s/>]")
    return _by_format(raw, wrapped, F.lit(True), lambda b: _odd_addresses(_header_pairs(b)), F.lit(False))


def plain_message(raw: Column) -> Column:
    """The message, a struct of the e-mail schema, of a text that doesn't need the parser; null: empty."""
    raw = F.coalesce(raw, F.lit(""))
    return _by_format(raw, lambda v: of_json(raw, v), F.lit(None).cast(SCHEMA), lambda b: of_header_block(raw, b), of_text(raw))


# Paths ------------------------------------------------------------------------------------------------------------

#: What a path looks like: names by dots, places of lists in brackets.
PATH = r"^[A-Za-z_][A-Za-z0-9_]*(\[[0-9]{1,9}\])*(\.[A-Za-z_][A-Za-z0-9_]*(\[[0-9]{1,9}\])*)*$"


def value_at(v: Column, path: Column) -> Column:
    """The VARIANT at a path such as ``url_signals[0].risk_flags``, which may differ from row to row; null where the path or the value isn't."""
    return F.when(path.rlike(PATH), F.try_variant_get(v, F.concat(F.lit("$."), F.when(path.rlike(PATH), path).otherwise("x")), "variant"))
