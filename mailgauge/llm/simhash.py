"""Operator 1: SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailgauge.llm.common import LOWER, NO_ID, UPPER, WIDE, components, cut, packed, release, small, table

SEED, BITS = 42, 64
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of each ``width``-word shingle of a text in UTF-8, A-Z lower-cased, repeats included; fewer words make one."""
    words = data.translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends[width - 1 :].tolist() or [len(joined)]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)), "<u8", len(last))


def simhash(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have; 0 of none. Counted in blocks, so memory doesn't grow with the text."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        count += _bits(hashes[at : at + (1 << 16)]).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(data: bytes, width: int) -> int:
    return simhash(shingle_hashes(data, width))


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp) of each row of (doc_id, text); fp as a signed long, null text as an empty one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t, width) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())

    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", F.arrow_udf(run, "long")(text).alias("fp"))


def bit_partitions(classes: DataFrame, m: int) -> list[list[int]]:
    """The 64 bits in ``m`` parts of one size, correlated bits together, by their correlation over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            x = _bits(b["fp"].to_numpy()).astype(np.float32)
            n += len(x)
            both += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BITS * BITS)), pa.array(np.concatenate([[n], both.ravel()]))], names=["cell", "n"])

    got = dict(classes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    n = max(1, got.get(-1, 0))
    both = np.array([got.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS) / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    near = np.abs((both - np.outer(p, p)) / np.outer(spread, spread)).round(6)
    np.fill_diagonal(near, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        part = [max(free, key=lambda i: (near[i, free].max(), -i))]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda i: (near[i, part].sum(), -i)))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def _keys(bits: np.ndarray, part: list[int]) -> np.ndarray:
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


#: A part's key is estimated from pieces of up to this many bits, so a piece's histogram has a bounded size.
PIECE = 16


def _pieces(part: list[int]) -> list[list[int]]:
    k = -(-len(part) // PIECE)
    return [part[i * len(part) // k : (i + 1) * len(part) // k] for i in range(k)]


def piece_histograms(classes: DataFrame, parts: list[list[int]]) -> list[list[np.ndarray]]:
    """For each piece of each part, how many of all fingerprints have each value: at most 2^PIECE numbers a piece."""
    pieces = [x for part in parts for x in _pieces(part)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = _bits(b["fp"].to_numpy())
            for i, piece in enumerate(pieces):
                v, n = np.unique(_keys(bits, piece), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(n.astype(np.int64))], names=["piece", "value", "n"])

    got = classes.select("fp").mapInArrow(run, "piece int, value long, n long").groupBy("piece", "value").agg(F.sum("n").alias("n")).toArrow()
    at, value, n = (got[c].to_numpy() for c in ("piece", "value", "n"))
    flat = [np.bincount(value[at == i], n[at == i], 1 << len(piece)) for i, piece in enumerate(pieces)]
    out = []
    for part in parts:
        out.append([flat.pop(0) for _ in _pieces(part)])
    return out


def _balls(h: np.ndarray, most: int) -> list[np.ndarray]:
    """By distance 0 to ``most``: for each value, how many rows have a value at exactly that distance."""
    out, at, width = [h], np.arange(len(h)), len(h).bit_length() - 1
    for d in range(1, most + 1):
        step = sum((out[-1][at ^ (1 << j)] for j in range(width)), np.zeros(len(h)))
        out.append((step - (width - d + 2) * out[-2] if d > 1 else step) / d)
    return out


class Allocator:
    """Each fingerprint's thresholds for the parts: sum is distance - m + 1, -1 leaves a part out, by dynamic programming
    over the estimated cost of each part and threshold: its probes and the candidates that they are expected to meet."""

    def __init__(self, parts: list[list[int]], histograms: list[list[np.ndarray]], distance: int):
        self.parts, self.distance = parts, distance
        self.total = max(1.0, float(histograms[0][0].sum()))
        self.balls = [[_balls(h, distance) for h in hs] for hs in histograms]
        self.masks = [[np.array([sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(len(p)), d)], np.int64) for t in range(distance + 1)] for p in parts]

    def costs(self, bits: np.ndarray) -> list[np.ndarray]:
        """For each part an array (threshold + 1, row)."""
        out = []
        for part, balls, masks in zip(self.parts, self.balls, self.masks, strict=True):
            ways = [np.ones(len(bits))] + [np.zeros(len(bits))] * self.distance
            for k, (piece, ball) in enumerate(zip(_pieces(part), balls, strict=True)):
                v = _keys(bits, piece)
                own = [b[v] / (self.total if k else 1) for b in ball]
                ways = [sum(ways[i] * own[d - i] for i in range(d + 1)) for d in range(self.distance + 1)]
            met = np.cumsum(ways, axis=0)
            out.append(np.stack([np.zeros(len(bits)), *[met[t] + len(masks[t]) for t in range(self.distance + 1)]]))
        return out

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """(part, row); sums are kept shifted by one a part, so that they run from 0 to distance + 1."""
        goal, rows = self.distance + 1, np.arange(len(bits))
        best = np.full((goal + 1, len(bits)), np.inf)
        best[0] = 0
        chosen = []
        for cost in self.costs(bits):
            options = np.full((goal + 1, goal + 1, len(bits)), np.inf)
            for s in range(goal + 1):
                for t in range(s + 1):
                    options[s, t] = best[s - t] + cost[t]
            chosen.append(options.argmin(axis=1))
            best = options.min(axis=1)
        out, s = [], np.full(len(bits), goal)
        for pick in reversed(chosen):
            t = pick[s, rows]
            out.append(t - 1)
            s = s - t
        return np.array(out[::-1])


def links(classes: DataFrame, distance: int = 2, m: int = 2, bucket_bound: int = 64) -> DataFrame:
    """(a, b): enough pairs of (fp, rep) rows' reps, of fingerprints at ``distance`` or fewer bits, to connect all such pairs.

    Every fingerprint is indexed under its key in each of ``m`` parts and probes, in each part, the keys
    within its threshold there; by the generalised pigeonhole principle each near fingerprint is met.
    Buckets of at most ``bucket_bound`` rows give candidates that are verified by their differing bits. What
    meets a larger bucket goes another exact way that makes no pairs: it is listed under every fingerprint
    within half the distance of it, and those under one such point are linked to the smallest; two
    fingerprints at up to ``distance`` (even) bits share a point, and those that share one are that near.
    """
    assert distance == 2, "points for large buckets are those of one bit"
    n = classes.count()
    classes = packed(classes, n, WIDE)
    parts = bit_partitions(classes, m)
    allocate = Allocator(parts, piece_histograms(classes, parts), distance)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = _bits(b["fp"].to_numpy())
            for i, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), i, np.int32)), pa.array(_keys(bits, part)), b["fp"], b["rep"]], names=["part", "key", "fp", "rep"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                fp, rep = b["fp"].to_numpy(), b["rep"].to_numpy()
                bits = _bits(fp)
                for i, (part, t) in enumerate(zip(parts, allocate.thresholds(bits), strict=True)):
                    keys = _keys(bits, part)
                    for d in range(distance + 1):
                        rows = np.flatnonzero(t == d)
                        if len(rows):
                            masks = allocate.masks[i][d]
                            each = np.repeat(rows, len(masks))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), i, np.int32)), pa.array((keys[rows][:, None] ^ masks[None, :]).ravel()), pa.array(np.tile(masks != 0, len(rows))), pa.array(fp[each]), pa.array(rep[each])], names=["part", "key", "moved", "fp", "rep"])

    rows = classes.mapInArrow(index, "part int, key long, fp long, rep long")
    # Counted once, so that the join with a hot key's probes has plain shuffles below it and can be split.
    sizes = cut(packed(rows.groupBy("part", "key").agg(F.count("*").alias("n")), n * m))
    met = classes.mapInArrow(probe, "part int, key long, moved boolean, fp long, rep long").join(sizes, ["part", "key"])
    met = cut(packed(met.where("moved or n > 1"), n * m))
    large = sizes.where(F.col("n") > bucket_bound).select("part", "key")
    pairs = met.where(F.col("n") <= bucket_bound).alias("q").join(rows.alias("x"), ["part", "key"])
    near = pairs.where("q.rep <> x.rep").where(F.bit_count(F.col("q.fp").bitwiseXOR(F.col("x.fp"))) <= distance)
    busy = met.where(F.col("n") > bucket_bound).select("fp", "rep").unionAll(rows.join(large, ["part", "key"]).select("fp", "rep")).distinct()
    shifts = F.explode(F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))).alias("bit")
    points = busy.select("rep", "fp", shifts).select("rep", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    starred = points.withColumn("least", F.min("rep").over(Window.partitionBy("point"))).where("rep <> least")
    return near.select(F.col("q.rep").alias("a"), F.col("x.rep").alias("b")).unionAll(starred.select(F.col("rep").alias("a"), F.col("least").alias("b")))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, m: int = 2, bucket_bound: int = 64) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of (doc_id, text).

    Documents of one fingerprint form a class, which takes part once, under its smallest id; a component
    is what links of at most ``distance`` bits connect, named by its smallest id. Rows of a class reach it
    by a join on the fingerprint, whose hot keys Spark splits.

    Null text counts as empty: fingerprint zero, linked like any other. A null id ranks below all others
    and comes back as null, in component_id too. Repeated ids are rows of their own. Extra columns aren't
    returned. An empty table gives an empty result.
    """
    own = cut(fingerprints(docs, width))
    n = own.count()
    classes = cut(packed(own.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep")), n))
    roots = components(links(classes, distance, m, bucket_bound), n)
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = packed(own.join(named, "fp"), n)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))


#: Bands of smallest hashes, and hashes a band: 99.9 % of pairs at a similarity of 0.8 share one.
BANDS, ROWS = 20, 5


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest value under each of BANDS * ROWS hash functions."""
    odd = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    hashes = np.unique(hashes)
    for at in range(0, len(hashes), 4096):
        x = (hashes[at : at + 4096, None] ^ (hashes[at : at + 4096, None] >> np.uint64(31))) * odd
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of the ROWS smallest values of each of BANDS bands."""
    mixed = least.reshape(BANDS, ROWS)
    out = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        out = (out ^ mixed[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """One bit of each smallest value, in two longs: the more bits agree, the likelier texts are similar. It ranks candidates only."""
    return np.packbits((least >> np.uint64(7) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes().ljust(16, b"\0")


def jaccard(a: bytes, b: bytes, width: int) -> float:
    x, y = (set(shingle_hashes(t, width).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


#: Texts, and bytes of texts, of a chunk of a bucket; the pairs of two chunks are compared in one task.
CHUNK, CHUNK_BYTES = 512, 1 << 21
#: Shingles that are counted at once.
SLICE = 2048
#: Ids of up to this many texts are broadcast to fetch the texts.
MOST_ASKED = 200_000


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``x`` shares with each of ``y``; counted in slices, so memory doesn't grow with the texts."""
    sets = x + y
    owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, at = owner[n[at] > 1], (np.cumsum(n > 1) - 1)[at[n[at] > 1]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(x), len(y)))
    for lo in range(0, int((n > 1).sum()), SLICE):
        a, b = np.searchsorted(at, [lo, lo + SLICE])
        has = np.zeros((len(sets), SLICE), np.float32)
        has[owner[a:b], at[a:b] - lo] = 1
        out += has[: len(x)] @ has[len(x) :].T
    return out


def _compare_block(width: int, similarity: float):
    """Texts (a, b, place, node, root, data) of one block to links (a, b) of near texts of different roots, as many as connect them."""

    def run(block: pa.Table) -> pa.Table:
        a, b = block["a"][0].as_py(), block["b"][0].as_py()
        place, node, root = (block[c].to_pylist() for c in ("place", "node", "root"))
        sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in block["data"]]
        x, y = ([i for i, p in enumerate(place) if p == k] for k in (a, b))
        links, group = [], {r: r for r in root}

        def find(r: int) -> int:
            while group[r] != r:
                group[r] = group[group[r]]
                r = group[r]
            return r

        if x and y:
            size, shared = np.array([len(v) for v in sets]), overlaps([sets[i] for i in x], [sets[i] for i in y])
            rate = shared / (size[x][:, None] + size[y][None, :] - shared)
            for i, j in np.argwhere(rate >= similarity).tolist():
                u, v = find(root[x[i]]), find(root[y[j]])
                if u != v:
                    group[u] = v
                    links.append((node[x[i]], node[y[j]]))
        return pa.table({"a": pa.array([u for u, _ in links], pa.int64()), "b": pa.array([v for _, v in links], pa.int64())})

    return run


def blocks(texts: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """(band, key, a, b, place, node, root) of the ``n`` texts (node, size, bands) of each bucket of over three that have several roots.

    A bucket's texts of its most frequent root and its other ones are dealt into chunks by a hash; a block is a
    pair of chunks, a and b, not both of that root, so any two texts of different roots meet in a block. Buckets
    of the same texts count once. Of up to three texts all pairs have been compared with the leaders.
    """
    members = texts.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    members = members.select("node", "size", F.coalesce("root", "node").alias("root"), F.posexplode("bands").alias("band", "key"))
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.hash("node").cast("long")).alias("s")]
    mixed = members.groupBy("band", "key").agg(*same, F.min("root").alias("lo"), F.max("root").alias("hi")).where("n > 3 and lo <> hi")
    mixed = cut(packed(packed(mixed, n).groupBy("n", "x", "s").agg(F.min(F.struct("band", "key")).alias("k")).select("k.*"), n))
    left = cut(packed(members.join(mixed, ["band", "key"]), n * BANDS))
    by_root = cut(packed(left.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size")), n))
    sums = by_root.groupBy("band", "key").agg(F.max(F.struct("n", "root", "size")).alias("m"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    chunks = lambda n, size: F.greatest(F.ceil(n / CHUNK), F.ceil(size / CHUNK_BYTES)).cast("long")
    mains, others = chunks(F.col("m.n"), F.col("m.size")), chunks(F.col("n") - F.col("m.n"), F.col("size") - F.col("m.size"))
    sums = cut(packed(sums, n).select("band", "key", F.col("m.root").alias("main"), mains.alias("mains"), others.alias("others")))
    placed = left.join(sums, ["band", "key"]).withColumn("own", F.col("root") == F.col("main"))
    place = F.when(F.col("own"), F.col("others") + F.expr("pmod(xxhash64(node), mains)")).otherwise(F.expr("pmod(xxhash64(node), others)"))
    placed = placed.withColumn("place", place)
    every = F.sequence(F.lit(0).cast("long"), F.col("others") + F.when(F.col("own"), 0).otherwise(F.col("mains")) - 1)
    pairs = F.explode(F.transform(every, lambda k: F.struct(F.least("place", k).alias("a"), F.greatest("place", k).alias("b")))).alias("p")
    return placed.select("band", "key", "place", "node", "root", pairs).select("band", "key", "p.a", "p.b", "place", "node", "root")


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """(id, t, u, size, fp, bands, sketch) of each row of (doc_id, text); t and u are two hashes of the text."""
    made = "fp long, bands array<long>, sketch binary"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, len(texts), 512):
                fps, keys, marks = [], [], []
                for t in texts.slice(at, 512):
                    h = shingle_hashes(t.as_py(), width)
                    least = smallest(h)
                    fps.append(simhash(h))
                    keys.append(bands(least) if len(h) else np.zeros(0, np.int64))
                    marks.append(sketch(least))
                columns = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
                yield pa.StructArray.from_arrays(columns, names=["fp", "bands", "sketch"])

    data = F.coalesce("text", F.lit("")).cast("binary")
    own = docs.select(*_keys_of(), F.length(data).cast("long").alias("size"), F.arrow_udf(run, made)(data).alias("m"))
    return own.select("id", "t", "u", "size", "m.*")


def _keys_of() -> list:
    return [F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u")]


def near_texts(texts: DataFrame, docs: DataFrame, width: int, similarity: float, distance: int) -> DataFrame:
    """(node, root) of the texts (node, id, t, u, size, fp, bands, sketch) that links connect; see keep_one."""
    n = texts.count()
    classes = cut(packed(texts.groupBy("fp").agg(F.min("node").alias("rep")), n))
    alike = texts.join(classes, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    keyed = texts.select("node", "sketch", F.posexplode("bands").alias("band", "key"))
    drawn = F.struct(F.xxhash64("band", "node").alias("h"), "node", "sketch")
    leaders = keyed.groupBy("band", "key").agg(F.array(F.min(drawn), F.max(drawn)).alias("leads"), F.count("*").alias("n")).where("n > 1")
    leaders = cut(packed(leaders, n).select("band", "key", "n", F.explode("leads").alias("lead")).select("band", "key", "n", F.col("lead.node").alias("lead"), F.col("lead.sketch").alias("mark")))
    part = lambda c, at: F.conv(F.hex(F.substring(c, at, 4)), 16, 10).cast("long")
    apart = sum(F.bit_count(part("sketch", at).bitwiseXOR(part("mark", at))) for at in (1, 5, 9, 13))
    met = keyed.join(leaders, ["band", "key"]).where("node <> lead").select("node", "lead", "n", apart.alias("apart"))
    met = cut(packed(packed(met, n * BANDS).distinct(), n))
    # All pairs of buckets of up to three texts; of larger ones, each text with the leader that looks the nearest.
    best = packed(met.where("n > 3").groupBy("node").agg(F.min(F.struct("apart", "lead"))["lead"].alias("lead")), n)
    pairs = met.where("n <= 3").select("node", "lead").unionAll(best)
    pairs = cut(packed(pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), n))
    # A text of any bucket of several stands in met. Each is fetched once.
    asked = small(texts.join(met.select("node").distinct(), "node").select("node", "id", "t", "u"), MOST_ASKED)
    body = docs.select(*_keys_of(), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    bodies = cut(packed(body.join(asked, ["id", "t", "u"]).select("node", "data").dropDuplicates(["node"]), n, WIDE))
    release(docs.sparkSession)
    left = packed(pairs.join(bodies.select(F.col("node").alias("a"), F.col("data").alias("x")), "a"), n, WIDE)
    sides = left.join(bodies.select(F.col("node").alias("b"), F.col("data").alias("y")), "b")

    def rate(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for xs, ys in batches:
            yield pa.array([jaccard(x.as_py(), y.as_py(), width) for x, y in zip(xs, ys, strict=True)], pa.float64())

    near = sides.where(F.arrow_udf(rate, "double")("x", "y") >= similarity).select("a", "b")
    roots = components(links(classes, distance).unionAll(alike).unionAll(near))
    rest = blocks(texts, roots, n)
    release(docs.sparkSession)
    late = cut(rest.join(bodies, "node").groupBy("band", "key", "a", "b").applyInArrow(_compare_block(width, similarity), "a long, b long"))
    if late.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(late))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """Rows of ``docs`` but for all of each group of near-duplicates except the one of the smallest id.

    Groups are what links connect: equal texts, SimHash fingerprints of ``width``-word shingles within
    ``distance`` bits, and texts whose shingle sets have a Jaccard similarity of ``similarity`` or more. Pairs
    at 0.8 differ in up to a quarter of the bits, too many for the pigeonhole search, so candidates for
    those links share a band of smallest hashes and are verified on their whole texts: first every text with a
    leader of its buckets, then, in blocks, any two of a bucket that aren't linked yet.

    Null text counts as empty; texts without words are alike. Null ids rank below all. Rows are told apart by id
    and text, so different texts under one id, or without one, are rows of their own; of a group's rows with the smallest
    id the one of the smallest hash of its text stays. Of rows equal in id and text one stays, any of them. All columns pass
    through, whatever their names. An empty table gives an empty result.
    """
    own = cut(_signed(docs, width))
    n = own.count()
    own = packed(own, n)
    # A row a text, under its smallest id; its node is a number of its own.
    texts = own.groupBy("t", "u").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("fp", "bands", "sketch", "size")])
    texts = cut(packed(texts, n).withColumn("node", F.monotonically_increasing_id()))
    roots = near_texts(texts, docs, width, similarity, distance)
    named = texts.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    first = named.groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("id", "t", "u")).alias("k")).select("k.*")
    rows = own.groupBy("id", "t", "u").agg(F.count("*").alias("n"))
    rows = cut(packed(rows.join(first.withColumn("stays", F.lit(True)), ["id", "t", "u"], "left"), n))
    gone, again = (rows.where(c).select("id", "t", "u") for c in ("stays is null", "stays and n > 1"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys_of())
    out = out.join(small(gone, MOST_ASKED), ["id", "t", "u"], "left_anti")
    if not again.isEmpty():
        again = small(again, MOST_ASKED)
        once = out.join(again, ["id", "t", "u"], "left_semi").dropDuplicates(["id", "t", "u"])
        out = out.join(again, ["id", "t", "u"], "left_anti").unionByName(once)
    return out.select("row.*")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
