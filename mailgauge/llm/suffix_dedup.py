"""Operator 2: removal of long repeated strings by enhanced suffix arrays."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm.common import NO_ID, cut, small, table

#: Bytes of an anchor. Longer ones meet by chance less often; shorter ones stand farther apart.
ANCHOR = 24
#: Different runs of one anchor in a chunk that one suffix array takes.
CHUNK = 2048
#: Bytes of runs that are sorted at once.
BLOCK = 1 << 21
#: Keys of up to this many repeated rows are broadcast.
MOST_AGAIN = 200_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of ``length`` bytes as runs of successive starts that share an anchor: first and last start, anchor, its hash.

    A window's anchor is its ANCHOR-byte string of the smallest hash, the first of them if several: equal
    windows, wherever they stand, have equal anchors at equal places.
    """
    n, grams = len(data), length - ANCHOR + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    m = n - ANCHOR + 1
    h = np.zeros(m, np.uint64)
    for k, mul in enumerate(_MULTIPLIERS[: ANCHOR // 8]):
        h ^= words[8 * k : 8 * k + m] * mul
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # The place in the low half makes the smallest unique and the first of equal ones; its order needs the high half only.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    span = 1
    while span * 2 <= grams:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if grams > span:
        key = np.minimum(key[: len(key) - (grams - span)], key[grams - span :])
    anchor = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    at = anchor[first]
    return first, last, at, h[at]


def window_hashes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit polynomial hash of the ``length`` bytes from each start; equal bytes have equal hashes."""
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    power = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(text), b, np.uint64))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power(base)[:-1], dtype=np.uint64)])
    return (sums[starts + length] - sums[starts]) * power(inverse)[starts]


def suffix_order(text: np.ndarray, limits: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Enhanced suffix array of the suffixes at ``starts``, each up to its limit: their order by group and bytes, and the
    common prefix of each with the one before it in that order; 0 for a group's first."""
    left = limits[starts] - starts
    padded = np.concatenate([text, np.zeros(width + 16, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded.tobytes(), strides=(1,))
    wide = -(-width // 8)
    columns = np.empty((wide, len(starts)), np.uint64)
    for k in range(wide):
        have = np.clip(left - 8 * k, 0, 8).astype(np.uint64)
        mask = np.where(have > 0, np.uint64(0xFFFFFFFFFFFFFFFF) << ((np.uint64(8) - np.maximum(have, np.uint64(1))) * np.uint64(8)), np.uint64(0))
        columns[k] = words[starts + 8 * k] & mask
    order = np.lexsort((starts, left, *columns[::-1], group))
    c, common = columns[:, order], np.zeros(len(order), np.int64)
    alive = np.ones(max(0, len(order) - 1), bool)
    for k in range(wide):
        x = (c[k, 1:] ^ c[k, :-1]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        common[1:] += np.where(alive, np.where(x.any(axis=1), x.argmax(axis=1), 8), 0)
        alive &= ~x.any(axis=1)
    common[1:] = np.minimum(common[1:], np.minimum(left[order][1:], left[order][:-1]))
    common[1:][group[order][1:] != group[order][:-1]] = 0
    return order, common


def maximal_repeats(common: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the groups of suffixes, in suffix order, that form maximal repeats of ``least`` bytes or more.

    Scans the common prefixes with a stack of open intervals, of the common-prefix interval tree, and carries
    for each whether the bytes before its suffixes differ; only such intervals, which no longer
    string at an earlier start covers, are given out. ``before``: the byte before each suffix, or a negative
    number of its own where there is none.
    """
    stack: list[list] = []  # length, first, the byte before all suffixes or None if they differ
    n = len(common)
    for i in range(1, n + 1):
        lcp = int(common[i]) if i < n else 0
        lcp = lcp if lcp >= least else 0
        first, byte = i - 1, before[i - 1]
        while stack and stack[-1][0] > lcp:
            length, first, mixed = stack.pop()
            mixed = mixed if mixed is not None and mixed == byte else None
            byte = mixed
            if byte is None:
                yield length, first, i - 1
        if lcp:
            if stack and stack[-1][0] == lcp:
                if stack[-1][2] is not None and (byte is None or stack[-1][2] != byte):
                    stack[-1][2] = None
            else:
                stack.append([lcp, first, byte])


def repeats(groups: np.ndarray, texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """The maximal repeats of ``length`` bytes or more among texts of one group, each as all its (text, start, length).

    One suffix array serves all groups. Only suffixes go into it of which another in the group has the
    same hash of the first ``length`` bytes; the others share no such string.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    text, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes)
    begins, owner = ends - sizes, np.repeat(np.arange(len(texts)), sizes)
    limits, place = ends[owner], np.arange(len(text))
    starts = place[limits - place >= length]
    by_hash = np.lexsort((h := window_hashes(text, starts, length), g := groups[owner[starts]]))
    same = (h[by_hash][1:] == h[by_hash][:-1]) & (g[by_hash][1:] == g[by_hash][:-1])
    twice = np.zeros(len(starts), bool)
    twice[by_hash[1:][same]] = twice[by_hash[:-1][same]] = True
    if not twice.any():
        return
    starts, g = starts[twice], g[twice]
    order, common = suffix_order(text, limits, starts, g, int(sizes.max()))
    at = starts[order]
    own = owner[at]
    before = np.where(at > begins[own], text[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))
    own, offset = own.tolist(), (at - begins[own]).tolist()
    for size, first, last in maximal_repeats(common.tolist(), before.tolist(), length):
        yield [(own[i], offset[i], size) for i in range(first, last + 1)]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first, end) in order, those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def spans_of(groups: np.ndarray, texts: list[bytes], ids: list[tuple[int, int, int]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, tag, first, end) of all but the earliest place of each maximal repeat, joined text by text; ids: id, tag and place of each."""
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for places in repeats(groups, texts, length):
        first = min((*ids[t][:2], ids[t][2] + start) for t, start, _ in places)
        for t, start, size in places:
            if (*ids[t][:2], ids[t][2] + start) != first:
                spans[t].append((start, start + size))
    for t, found in spans.items():
        i, tag, lo = ids[t]
        for a, b in union(found):
            yield i, tag, lo + a, lo + b


def _batch(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_I = pa.int64()
_RUNS = [("kind", pa.int32()), ("h", _I), ("dig", _I), ("id", _I), ("tag", _I), ("lo", _I), ("hi", _I)]
_FOUND = [("h", _I), ("chunk", pa.int32()), ("id", _I), ("tag", _I), ("lo", _I), ("hi", _I)]
_SPANS = [("key", pa.binary()), ("id", _I), ("tag", _I), ("lo", _I), ("hi", _I)]


def _find_runs(length: int):
    """Documents (id, tag, data) to runs, kind 0; a run that an earlier one of the same batch equals is at once a span, kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, digest = [], xxhash.xxh3_64_intdigest
            for i, (ident, tag, data) in enumerate(zip(b["id"].to_pylist(), b["tag"].to_pylist(), b["data"].to_pylist(), strict=True)):
                first, last, _, h = runs(data, length)
                if len(first):
                    end = last + length
                    d = np.array([digest(data[x:y]) for x, y in zip(first.tolist(), end.tolist(), strict=True)], np.uint64)
                    parts.append((h.view(np.int64), d.view(np.int64), np.full(len(first), ident), np.full(len(first), tag), first, end))
            if not parts:
                continue
            h, d, ident, tag, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((lo, tag, ident, d, h))
            h, d, ident, tag, lo, hi = (x[order] for x in (h, d, ident, tag, lo, hi))
            again = np.append(False, (h[1:] == h[:-1]) & (d[1:] == d[:-1]))
            yield _batch(_RUNS, np.zeros((~again).sum(), np.int32), *(x[~again] for x in (h, d, ident, tag, lo, hi)))
            if again.any():
                ident, tag, lo, hi = (x[again] for x in (ident, tag, lo, hi))
                order = np.lexsort((lo, tag, ident))
                ident, tag, lo, hi = (x[order] for x in (ident, tag, lo, hi))
                new = np.append(True, (ident[1:] != ident[:-1]) | (tag[1:] != tag[:-1]) | (lo[1:] > hi[:-1]))
                # Ends grow with starts inside a document, so a merged span ends where its last run does.
                at = np.flatnonzero(new)
                end = hi[np.append(at[1:], len(hi)) - 1]
                yield _batch(_RUNS, np.ones(len(at), np.int32), ident[at], np.zeros(len(at), np.int64), ident[at], tag[at], lo[at], end)

    return run


def _sift_runs():
    """Runs in order of kind, h, dig, id, tag, lo: all but the first of equal ones become spans (h null), and of anchors with
    several different runs the first of each goes on, with a chunk of CHUNK such. Holds one row between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0  # the last different run, (h, dig, id, tag, lo, hi, given), and its number among its anchor's
        for b in batches:
            kind, *cols = (b[n].to_numpy() for n, _ in _RUNS)
            spans = [[c[kind == 1] for c in cols[2:]]]
            h, d, ident, tag, lo, hi = (c[kind == 0] for c in cols)
            if len(h):
                ph, pd = (held[0], held[1]) if held else (~h[0], d[0])
                new = np.append(h[0] != ph or d[0] != pd, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
                spans.append([c[~new] for c in (ident, tag, lo, hi)])
                rows = [c[new] for c in (h, d, ident, tag, lo, hi)]
                if held:
                    rows = [np.append(x, c).astype(np.int64) for x, c in zip(held[:6], rows, strict=True)]
                n, h = len(rows[0]), rows[0]
                begin = np.append(not held or seen == 0, h[1:] != h[:-1])
                begin[0] = True
                at = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
                number = np.arange(n) - at + np.where(at == 0, seen if held else 0, 0)
                more = np.append(h[1:] == h[:-1], False)
                give = (number > 0) | more
                if held and held[6]:
                    give[0] = False
                yield _batch(_FOUND, h[give], (number[give] // CHUNK).astype(np.int32), *(c[give] for c in rows[2:]))
                held, seen = (*(int(c[-1]) for c in rows), bool(give[-1]) or bool(held and held[6] and n == 1)), int(number[-1])
            ident, tag, lo, hi = (np.concatenate(x) for x in zip(*spans, strict=True))
            yield _batch(_FOUND, [None] * len(ident), np.zeros(len(ident), np.int32), ident, tag, lo, hi)

    return run


def _cut_runs():
    """(id, tag, data, runs) to rows with each run's bytes."""
    schema = [("h", _I), ("chunk", pa.int32()), ("id", _I), ("tag", _I), ("lo", _I), ("bytes", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ident, tag, data, found in zip(*(b[n].to_pylist() for n in ("id", "tag", "data", "runs")), strict=True):
                yield _batch(schema, *zip(*((r["h"], r["chunk"], ident, tag, r["lo"], data[r["lo"] : r["hi"]]) for r in found), strict=True))

    return run


def _search(length: int):
    """Runs with their bytes, in order of h and chunk: the spans of all but the earliest place of their repeats (key null).

    Of an anchor with more than one chunk, each different window's earliest place goes on, under the window's digest.
    """

    def block(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = [r[:2] for r in rows]
        numbers = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        groups, texts, ids = np.array([numbers[k] for k in keys]), [r[5] for r in rows], [r[2:5] for r in rows]
        found = list(spans_of(groups, texts, ids, length))
        if found:
            yield _batch(_SPANS, [None] * len(found), *zip(*found, strict=True))
        full = np.bincount(groups) >= CHUNK
        first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        for (h, chunk, *ident, data), g in zip(rows, groups.tolist(), strict=True):
            if chunk or full[g]:
                for k in range(len(data) - length + 1):
                    key, place = (g, xxhash.xxh3_128_digest(data[k : k + length])), (ident[0], ident[1], ident[2] + k)
                    first[key] = min(first.get(key, place), place)
        if first:
            i, tag, lo = zip(*first.values(), strict=True)
            yield _batch(_SPANS, [k for _, k in first], i, tag, lo, [x + length for x in lo])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for b in batches:
            for row in zip(*(b[n].to_pylist() for n in ("h", "chunk", "id", "tag", "lo", "bytes")), strict=True):
                if total > BLOCK and row[:2] != rows[-1][:2]:
                    yield from block(rows)
                    rows, total = [], 0
                rows.append(row)
                total += len(row[5])
        if rows:
            yield from block(rows)

    return run


def _later():
    """Windows in order of key, id, tag, lo: all but each key's first. Rows without a key pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            keys = b["key"].to_pylist()
            keep = np.array([k is None or k == p for k, p in zip(keys, [last, *keys[:-1]], strict=True)], bool)
            last = keys[-1] if keys else last
            yield pa.RecordBatch.from_arrays([b[n].filter(pa.array(keep)) for n in ("id", "tag", "lo", "hi")], names=["id", "tag", "lo", "hi"])

    return run


def repeat_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(id, tag, lo, hi) of byte spans of (id, tag, data) documents: together they cover just what op2 removes.

    Windows of ``length`` bytes are dealt by their anchor, so that equal ones meet. A run of windows is first
    told from others by a hash of its bytes, with equal ones reduced to the earliest in each batch before the shuffle;
    only the bytes of different runs of one anchor are fetched and go through suffix arrays.
    """
    shape = lambda s: ", ".join(f"{n} {'binary' if t == pa.binary() else 'int' if t == pa.int32() else 'long'}" for n, t in s)
    dealt = docs.mapInArrow(_find_runs(length), shape(_RUNS)).repartition("h").sortWithinPartitions("kind", "h", "dig", "id", "tag", "lo")
    found = dealt.mapInArrow(_sift_runs(), shape(_FOUND))
    asked = found.where("h is not null").groupBy("id", "tag").agg(F.collect_list(F.struct("h", "chunk", "lo", "hi")).alias("runs"))
    bytes_of = docs.join(asked, ["id", "tag"]).mapInArrow(_cut_runs(), "h long, chunk int, id long, tag long, lo long, bytes binary")
    met = bytes_of.repartition("h", "chunk").sortWithinPartitions("h", "chunk").mapInArrow(_search(length), shape(_SPANS))
    met = met.repartition(F.when(F.col("key").isNull(), F.col("id")).otherwise(F.xxhash64("key"))).sortWithinPartitions("key", "id", "tag", "lo").mapInArrow(_later(), shape(_SPANS[1:]))
    return found.where("h is null").select("id", "tag", "lo", "hi").unionAll(met)


def once(docs: DataFrame) -> DataFrame:
    """(id, tag, data) documents without repeats of an (id, tag); only the data of repeated ones are shuffled."""
    again = cut(docs.groupBy("id", "tag").agg(F.count("*").alias("n")).where("n > 1").select("id", "tag"))
    if again.isEmpty():
        return docs
    again = small(again, MOST_AGAIN)
    return docs.join(again, ["id", "tag"], "left_anti").unionByName(docs.join(again, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"]))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and removed, an array of (lo, hi), of each row of (doc_id, text).

    Every byte goes that a ``length``-byte string covers which also starts earlier: in a smaller id, or in
    the same text before. Null text is empty. Null ids rank below all. Rows that share an id are ordered by a
    hash of their text, and identical rows count once and get one result. Texts shorter than ``length`` stay whole. Extra
    columns aren't returned. An empty table gives an empty result.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    own = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tag"), data.alias("data"))
    spans = repeat_spans(once(own), length).groupBy("id", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for datas, spans in batches:
            kept, removed = [], []
            for d, s in zip(datas.to_pylist(), spans.to_pylist(), strict=True):
                gone = union([(x["lo"], x["hi"]) for x in s or []])
                ends = [0, *(x for pair in gone for x in pair), len(d)]
                kept.append(b"".join(d[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                removed.append([{"lo": a, "hi": b} for a, b in gone])
            yield pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("lo", _I), ("hi", _I)])))], names=["kept", "removed"])

    joined = own.join(spans, ["id", "tag"], "left").withColumn("r", F.arrow_udf(run, "kept binary, removed array<struct<lo:long,hi:long>>")("data", "spans"))
    return joined.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.length("data").cast("long").alias("n_bytes"), (F.length("data") - F.length("r.kept")).cast("long").alias("n_removed"), F.size("r.removed").cast("long").alias("n_spans"), "r.kept", "r.removed")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
