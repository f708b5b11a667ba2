"""Bounded decoding of text layers, base64, data URIs and query values: built-in column expressions only.

Each function folds a value through the layers it may be wrapped in, within a Budget, and tells which bounds it met.
Nothing that is decoded is run or fetched.
"""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgauge.functions.text import bind, strip
from mailgauge.functions.url import any_of, extract_urls

#: Fixed patterns: an encoded byte; what counts as an entity; what may be a reference to a character; base64 in its two alphabets.
PERCENT = "%[0-9A-Fa-f]{2}"
ENTITY = r"&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,32});"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
BASE64, BASE64_URL = r"\A[A-Za-z0-9+/]+={0,2}\z", r"\A[A-Za-z0-9_-]+={0,2}\z"
#: Fixed pattern: media type, parameters and data of a data URI.
DATA_URI = r"(?i)\Adata:([^;,]*)((?:;[^,]*)?),([^\n]*)"
#: The fewest and the most characters that are taken for base64.
BASE64_CHARS = (16, 50_000)


@dataclass(frozen=True)
class Budget:
    """Fixed bounds of what is decoded: characters, rounds, query parameters and samples of them, base64, data URIs, nested URLs."""

    chars: int = 12_000
    rounds: int = 2
    params: int = 30
    param_chars: int = 800
    samples: int = 8
    key_chars: int = 80
    base64_chars: int = 4_000
    base64_bytes: int = 4_000
    sample_chars: int = 600
    nested: int = 8
    data_uri_chars: int = 6_000


BUDGET = Budget()


def _none() -> Column:
    return F.array().cast("array<string>")


def _literal(value: object, kind: str) -> Column:
    """A constant of a nested type; the optimiser evaluates it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def unquote(text: Column) -> Column:
    """Percent-encoded bytes as UTF-8, malformed ones as U+FFFD; percent signs that encode nothing and plus signs stay."""
    whole = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(whole), text)).otherwise(text)


# HTML's references ------------------------------------------------------------------------------------------------


def _named(name: Column) -> Column:
    """The characters of a named reference, null if there is none of this name; names are looked up by their first letter."""
    by: dict[str, dict[str, str]] = {}
    for k, v in html.entities.html5.items():
        by.setdefault(k[0], {})[k] = v
    return F.try_element_at(F.try_element_at(_literal(by, "map<string,map<string,string>>"), F.substring(name, 1, 1)), name)


def _named_start(name: Column) -> Column:
    """``&`` and ``name``, with its longest beginning replaced that is a name without a semicolon."""
    short = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
    known, lengths = _literal(short, "map<string,string>"), F.array(*map(F.lit, range(max(map(len, short)), 1, -1)))
    tried = F.transform(F.filter(lengths, lambda n: n < F.length(name)), lambda n: F.concat(F.try_element_at(known, name.substr(F.lit(1), n)), name.substr(n + 1, F.length(name))))
    return F.coalesce(F.get(F.array_compact(tried), F.lit(0)), F.concat(F.lit("&"), name))


def _character(n: Column) -> Column:
    """The character of a number: the C1 controls are those of windows-1252, other controls nothing, what is no character U+FFFD."""
    western = F.array(*[F.lit(bytes([c]).decode("cp1252", "ignore") or chr(c)) for c in range(0x80, 0xA0)])
    last_two = n.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE
    nothing = any_of([n.between(1, 8), n == 0x0B, n.between(0x0E, 0x1F), n == 0x7F, n.between(0xFDD0, 0xFDEF), last_two])
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(n.between(0x80, 0x9F), F.get(western, (n - 0x80).cast("int"))).when(nothing, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _numbered(name: Column) -> Column:
    digits = F.regexp_extract(name, r"^#[xX]?0*([0-9A-Fa-f]*)", 1)
    number = F.when(name.substr(2, 1).isin("x", "X"), F.conv(digits, 16, 10).try_cast("long")).otherwise(digits.try_cast("long"))
    return bind(F.when(digits == "", F.lit(0).cast("long")).when(F.length(digits) > 8, F.lit(1 << 30).cast("long")).otherwise(number), _character)


def unescape(text: Column) -> Column:
    """HTML's references replaced as HTML 5 reads them, with and without semicolons."""
    one = lambda name: F.when(name.startswith("#"), _numbered(name)).otherwise(F.coalesce(_named(name), _named_start(name)))
    reference = lambda ref: F.when(ref.isNull(), "").otherwise(bind(F.substr(ref, F.lit(2)), one))
    pieces = F.zip_with(F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), lambda gap, ref: F.concat(gap, reference(ref)))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


# Layers -----------------------------------------------------------------------------------------------------------


def _step(state: Column, name: str, asked: Column, decode: Callable[[Column], Column], b: Budget) -> Column:
    """``state`` (text, steps, cut, on) after one step of decoding where ``asked``; on: whether it changed the text."""

    def after(done: Column) -> Column:
        changed = done != state["text"]
        return F.struct(
            F.substring(done, 1, b.chars).alias("text"),
            F.when(changed, F.array_append(state["steps"], F.lit(name))).otherwise(state["steps"]).alias("steps"),
            (state["cut"] | (F.length(done) > b.chars)).alias("cut"),
            changed.alias("on"),
        )

    still = F.struct(state["text"].alias("text"), state["steps"].alias("steps"), state["cut"].alias("cut"), F.lit(False).alias("on"))
    return F.when(asked, bind(decode(state["text"]), after)).otherwise(still)


def text_layers(value: Column, b: Budget = BUDGET) -> Column:
    """A struct of the text behind HTML's references, replaced once, and percent-encoding, in at most ``rounds`` rounds that
    change something: text, steps, percent and entities (counted before), input_truncated, output_truncated. Null: empty."""

    def fold(text: Column, cut: Column) -> Column:
        start = F.struct(text.alias("text"), _none().alias("steps"), F.lit(False).alias("cut"), F.lit(True).alias("on"))
        entities, percent = F.regexp_count(text, F.lit(ENTITY)), F.regexp_count(text, F.lit(PERCENT))
        first = bind(start, lambda s: _step(s, "html_unescape", s["text"].rlike(ENTITY), unescape, b))
        first = bind(first, lambda s: F.struct(s["text"].alias("text"), s["steps"].alias("steps"), s["cut"].alias("cut"), F.lit(True).alias("on")))
        rounds = F.array(*map(F.lit, range(b.rounds)))
        done = F.aggregate(rounds, first, lambda s, _: _step(s, "percent_decode", s["on"] & s["text"].rlike(PERCENT), unquote, b))
        plain = F.struct(text.alias("text"), _none().alias("steps"), F.lit(False).alias("cut"), F.lit(False).alias("on"))
        out = F.when(text.rlike("[%&]"), done).otherwise(plain)
        names = lambda s: [s["text"].alias("text"), s["steps"].alias("steps"), percent.alias("percent"), entities.alias("entities"), cut.alias("input_truncated"), s["cut"].alias("output_truncated")]
        return bind(out, lambda s: F.struct(*names(s)))

    return bind(F.coalesce(value, F.lit("")), lambda v: bind(F.substring(v, 1, b.chars), lambda t: fold(t, F.length(v) > b.chars)))


# Base64 and data URIs ---------------------------------------------------------------------------------------------


def _utf8(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def printable_ratio(text: Column) -> Column:
    """Share of printable characters to two places, halves rounded as their binary fractions fall."""
    shown, every = F.length(F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ ]]", "")), F.length(text)
    halves = F.array(*[F.lit(round((2 * k + 1) / 200, 2)) for k in range(100)])
    half = (shown * 200 % every == 0) & ((shown * 200 / every).cast("int") % 2 == 1)
    return F.when(half, F.get(halves, ((shown * 200 / every).cast("int") / 2).cast("int"))).otherwise(F.round(shown / every, 2))


_BASE64_TYPE = "struct<kind:string,status:string,reason:string,input_len:int,decoded_bytes:int,decoded_bytes_truncated:boolean,text:string,text_truncated:boolean,printable_ratio:double>"


def base64_text(value: Column, b: Budget = BUDGET) -> Column:
    """A bounded sample of the text behind a base64 string; null for anything else.

    A struct: kind (base64 or base64url), status (ok; skipped if over the bound, with reason), input_len, decoded_bytes,
    decoded_bytes_truncated, text, text_truncated, printable_ratio.
    """

    def sample(raw: Column, data: Column) -> Column:
        def told(read: Column) -> Column:
            text = F.substring(read, 1, b.sample_chars)
            out = F.struct(
                F.when(raw.rlike(BASE64), "base64").otherwise("base64url").alias("kind"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"),
                F.length(raw).alias("input_len"), F.least(F.length(data), F.lit(b.base64_bytes)).alias("decoded_bytes"), (F.length(data) > b.base64_bytes).alias("decoded_bytes_truncated"),
                text.alias("text"), (F.length(read) > b.sample_chars).alias("text_truncated"), printable_ratio(text).alias("printable_ratio"),
            )
            return F.when(strip(text) != "", out)

        return bind(_utf8(F.substring(data, 1, b.base64_bytes)), told)

    def read(raw: Column) -> Column:
        data = F.translate(F.rtrim(raw, F.lit("=")), "-_", "+/")
        need = (4 - F.length(data) % 4) % 4
        sound = (F.length(data) % 4 != 1) & (F.length(raw) - F.length(data) <= need)
        none = F.lit(None).cast("string")
        skipped = F.struct(F.lit("base64").alias("kind"), F.lit("skipped").alias("status"), F.lit("input_too_large").alias("reason"), F.length(raw).alias("input_len"), F.lit(None).cast("int").alias("decoded_bytes"), F.lit(None).cast("boolean").alias("decoded_bytes_truncated"), none.alias("text"), F.lit(None).cast("boolean").alias("text_truncated"), F.lit(None).cast("double").alias("printable_ratio"))
        whole = F.try_to_binary(F.concat(data, F.substring(F.lit("==="), F.lit(1), need)), F.lit("base64"))
        looks = F.length(raw).between(*BASE64_CHARS) & (raw.rlike(BASE64) | raw.rlike(BASE64_URL))
        return F.when(looks, F.when(F.length(raw) > b.base64_chars, skipped).when(sound, bind(whole, lambda d: F.when(d.isNotNull(), sample(raw, d)))))

    return bind(strip(F.coalesce(value, F.lit(""))), read).cast(_BASE64_TYPE)


def _lenient(data: Column) -> Column:
    """Base64 with anything else in between, up to its padding; null where it is cut short. A fold over the characters."""
    known = F.regexp_replace(data, "[^A-Za-z0-9+/=]", "")
    zero = F.struct(F.lit(0).alias("taken"), F.lit(0).alias("pads"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        place, pads = s["taken"] % 4, s["pads"] + 1
        pad = F.struct(s["taken"].alias("taken"), F.when(place >= 2, pads).otherwise(s["pads"]).alias("pads"), ((place >= 2) & (place + pads >= 4)).alias("done"))
        return F.when(s["done"], s).when(c == "=", pad).otherwise(F.struct((s["taken"] + 1).alias("taken"), F.lit(0).alias("pads"), F.lit(False).alias("done")))

    def taken(k: Column, s: Column) -> Column:
        kept = F.replace(k, F.lit("="), F.lit("")).substr(F.lit(1), s["taken"])
        return F.when(s["done"] | (s["taken"] % 4 == 0), F.try_to_binary(F.concat(kept, F.substring(F.lit("=="), F.lit(1), (4 - s["taken"] % 4) % 4)), F.lit("base64")))

    return bind(known, lambda k: bind(F.aggregate(F.filter(F.split(k, ""), lambda c: c != ""), zero, step), lambda s: taken(k, s)))


def data_uri(value: Column, b: Budget = BUDGET) -> Column:
    """A struct of a data URI: status (ok, skipped, error), reason, mime, is_base64, decoded_bytes, text, truncated; null for anything else."""
    none = F.lit(None).cast("string")

    def struct(status: str, reason: Column, mime: Column, coded: Column, size: Column, text: Column, cut: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), reason.alias("reason"), mime.alias("mime"), coded.alias("is_base64"), size.alias("decoded_bytes"), text.alias("text"), cut.alias("truncated"))

    def refused(status: str, reason: str, mime: Column = none, coded: Column = F.lit(False)) -> Column:
        return struct(status, F.lit(reason), mime, coded, F.lit(0), F.lit(""), F.lit(False))

    def shown(mime: Column, coded: Column, size: Column, text: Column, cut: Column) -> Column:
        return struct("ok", none, mime, coded, size, F.substring(text, 1, b.sample_chars), cut | (F.length(text) > b.sample_chars))

    def binary(mime: Column, data: Column) -> Column:
        texts = mime.startswith("text/") | mime.isin("application/json", "application/xml") | mime.endswith("+xml")
        size = F.least(F.length(data), F.lit(b.base64_bytes))
        text = F.when(texts, _utf8(F.substring(data, 1, b.base64_bytes))).otherwise("")
        return F.when(data.isNull(), refused("error", "base64_decode_failed", mime, F.lit(True))).otherwise(bind(text, lambda t: shown(mime, F.lit(True), size, t, F.length(data) > b.base64_bytes)))

    def read(raw: Column) -> Column:
        mime, params, data = (F.regexp_extract(raw, DATA_URI, k) for k in (1, 2, 3))
        padded = bind(strip(data), lambda d: F.concat(d, F.substring(F.lit("==="), F.lit(1), (4 - F.length(d) % 4) % 4)))
        foreign = padded.rlike(r"[^\x00-\x7F]")
        coded = F.when(foreign, refused("error", "base64_decode_failed", F.lower(strip(mime)), F.lit(True))).otherwise(bind(_lenient(padded), lambda d: binary(F.lower(strip(mime)), d)))
        plain = bind(unquote(data), lambda t: shown(F.lower(strip(mime)), F.lit(False), F.lit(0), t, F.lit(False)))
        found = F.when(F.lower(params).contains(";base64"), coded).otherwise(plain)
        return F.when(F.lower(raw).startswith("data:"), F.when(F.length(raw) > b.data_uri_chars, refused("skipped", "input_too_large")).when(~raw.rlike(DATA_URI), refused("error", "invalid_data_uri")).otherwise(found))

    return bind(strip(F.coalesce(value, F.lit(""))), read)


# Queries of URLs --------------------------------------------------------------------------------------------------

#: Names of what a query shows.
ENCODED, CAPPED, NESTED, NESTED_CAPPED, HIDDEN = "percent_encoded_query", "query_param_cap_hit", "nested_url_in_query", "nested_url_cap_hit", "base64_decoded_query_value"


def query_of(url: Column) -> Column:
    """The query; none where square brackets enclose no IP address in the authority."""
    authority, query = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.when(authority.rlike(r"[\[\]]") & ~authority.rlike(r"^(?:[^@\[\]]*@)?\[[0-9A-Fa-f:.]+\](?::\d*)?$"), "").otherwise(query)


def _param(pair: Column, b: Budget) -> Column:
    """What one parameter hides: (nested, flags, sample)."""
    text = lambda part: unquote(F.replace(part, F.lit("+"), F.lit(" ")))
    key, value = text(F.substring_index(pair, "=", 1)), text(F.regexp_extract(pair, r"(?s)^[^=]*=(.*)$", 1))

    def told(raw: Column, long: Column, layers: Column, coded: Column) -> Column:
        def out(found: Column, inner: Column) -> Column:
            speaks = coded["status"].eqNullSafe("ok") & (coded["text"].contains("http://") | coded["text"].contains("https://") | F.lower(coded["text"]).contains("<html"))
            speaks = F.coalesce(speaks, F.lit(False))
            shown = (F.size(layers["steps"]) > 0) | (layers["percent"] > 0) | long | (F.size(found) > 0) | speaks
            sample = F.struct(
                F.substring(key, 1, b.key_chars).alias("key"), raw.alias("value"), long.alias("value_truncated"), F.substring(layers["text"], 1, b.sample_chars).alias("text"),
                layers["steps"].alias("steps"), coded.alias("base64"),
            )
            return F.struct(
                F.concat(found, F.when(speaks, inner).otherwise(_none())).alias("nested"),
                F.array_compact(F.array(F.when(F.size(found) > 0, F.lit(NESTED)), F.when(speaks, F.lit(HIDDEN)))).alias("flags"),
                F.when(shown, sample).alias("sample"),
            )

        return bind(extract_urls(layers["text"]), lambda found: bind(extract_urls(F.coalesce(coded["text"], F.lit(""))), lambda inner: out(found, inner)))

    def read(v: Column) -> Column:
        raw = F.substring(v, 1, b.param_chars)
        both = lambda r: bind(text_layers(r, b), lambda layers: bind(F.coalesce(base64_text(layers["text"], b), base64_text(r, b)), lambda coded: told(r, F.length(v) > b.param_chars, layers, coded)))
        return bind(raw, both)

    return bind(value, lambda v: F.when(v != "", read(v)))


_PARAM_TYPE = f"struct<nested:array<string>,flags:array<string>,sample:struct<key:string,value:string,value_truncated:boolean,text:string,steps:array<string>,base64:{_BASE64_TYPE}>>"
_FOUND_TYPE = "struct<params:int,flags:array<string>,nested:array<string>,samples:array<struct<key:string,value:string,value_truncated:boolean,text:string,steps:array<string>,base64:" + _BASE64_TYPE + ">>>"


def obfuscation(url: Column, b: Budget = BUDGET) -> Column:
    """What a URL's query hides, a struct: params (read), flags (sorted), nested (URLs in its values, in order), samples of values.

    Values are decoded as forms encode them, then through text_layers and base64_text. Null or no query: nothing.
    """

    def found(query: Column, pairs: Column) -> Column:
        read = F.array_compact(F.transform(F.slice(pairs, 1, b.params), lambda p: _param(p, b)))

        def told(values: Column) -> Column:
            def out(nested: Column) -> Column:
                tests = [(query.rlike(PERCENT), ENCODED), (F.size(pairs) > b.params, CAPPED), (F.size(nested) > b.nested, NESTED_CAPPED)]
                own = F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))
                return F.struct(
                    F.least(F.size(pairs), F.lit(b.params)).alias("params"),
                    F.array_sort(F.array_distinct(F.concat(own, F.flatten(F.transform(values, lambda v: v["flags"]))))).alias("flags"),
                    F.slice(nested, 1, b.nested).alias("nested"),
                    F.slice(F.array_compact(F.transform(values, lambda v: v["sample"])), 1, b.samples).alias("samples"),
                )

            return bind(F.array_distinct(F.flatten(F.transform(values, lambda v: v["nested"]))), out)

        return bind(read, told)

    nothing = F.struct(F.lit(0).alias("params"), _none().alias("flags"), _none().alias("nested"), F.array().cast(f"array<{_PARAM_TYPE}>")["sample"].alias("samples"))
    by_query = lambda q: F.when(q == "", nothing).otherwise(bind(F.filter(F.split(q, "&"), lambda p: p != ""), lambda pairs: found(q, pairs)))
    return bind(query_of(F.translate(strip(F.coalesce(url, F.lit(""))), "\t\r\n", "")), by_query).cast(_FOUND_TYPE)


def obfuscations(urls: Column, b: Budget = BUDGET) -> Column:
    """What the query of each URL of an array hides, in the same order."""
    return F.transform(urls, lambda u: obfuscation(u, b))
