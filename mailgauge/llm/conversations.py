"""Operator 12: repair the structure of conversations by error-correcting Earley parsing."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm.common import BLANKS, cut, table

#: The grammar of roles, left-linear: each nonterminal is a child and a role's initial, or the start, which is empty.
#: Every chart item then begins at the conversation's start, so that a column of the chart is all that a later row needs.
PRODUCTIONS = (("system", "start", "s"), ("user", "start", "u"), ("user", "system", "u"), ("user", "assistant", "u"), ("assistant", "user", "a"))
START, COMPLETE = "start", ("start", "assistant")
#: Roles that the error productions may give or insert, by initial.
GIVEN = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: A row's code: its role's initial (x: any other) in lower case, in upper case if its text is truncated; blank rows
#: and duplicates, which must go, have a code of their own by initial.
INITIALS, CUT_OFF, BLANK, DUPLICATE = "suax", "SUAX", "0123", "4567"
_PLAIN = {c: i for codes in (INITIALS, CUT_OFF, BLANK, DUPLICATE) for c, i in zip(codes, INITIALS)}
_LEGAL = {"su", "ua", "au"}
#: Rows of a conversation that are packed into one row for the parse, at most.
PACKED = 1024

Column = tuple[tuple[str, int, str], ...]


def _tails(audits: list[str]) -> dict[str, str]:
    """For each audit a short string that compares with the others', whatever is appended to both, as it does.

    Of letters that all of a group share none is needed, nor any behind those that tell an audit from all others.
    """
    out: dict[str, str] = {}

    def tell(group: list[str], at: int, shown: str) -> None:
        if len(group) == 1:
            out[group[0]] = shown
            return
        while all(len(a) > at for a in group) and len({a[at] for a in group}) == 1:
            at += 1
        by: dict[str, list[str]] = {}
        for a in group:
            by.setdefault(a[at : at + 1], []).append(a)
        for letter, part in by.items():
            if not letter:
                out[part[0]] = shown
            elif "" in by:  # one audit goes on where another ends: by inserts only, all of which count
                out.update({a: shown + a[at:] for a in part})
            else:
                tell(part, at + 1, shown + letter)

    tell(sorted(set(audits)), 0, "")
    return out


def _reach() -> dict[tuple[str, str], int]:
    """(x, y): what it costs at most to go on from nonterminal x as one could from y; a system row that can't follow is deleted."""
    between = {("start", "system"): 0, ("assistant", "system"): 0, ("assistant", "start"): DELETE}
    for left, child, initial in PRODUCTIONS:
        if initial in GIVEN:
            between[child, left] = min(between.get((child, left), INSERT), INSERT)
    names = [START, *dict.fromkeys(p[0] for p in PRODUCTIONS)]
    for via in names:
        for x in names:
            for y in names:
                if (x, via) in between and (via, y) in between:
                    between[x, y] = min(between.get((x, y), 1 << 30), between[x, via] + between[via, y])
    return between


REACH = _reach()


def _column(items: dict[str, tuple[int, str, tuple[str, str]]]) -> tuple[Column, int, dict[str, tuple[str, str]]]:
    """A column as its least cost and, apart from it, what later rows can tell apart; and where each item comes from.

    An item is left out where another's cost with what it takes to go on like it is less: no least repair goes through it.
    """
    live = [x for x in items if not any(items[y][0] + REACH.get((y, x), 1 << 30) < items[x][0] for y in items if y != x)]
    least, tails = min(items[x][0] for x in live), _tails([items[x][1] for x in live])
    return tuple((x, items[x][0] - least, tails[items[x][1]]) for x in sorted(live)), least, {x: items[x][2] for x in live}


def _complete(scanned: dict[str, tuple[int, str, tuple[str, str]]]) -> dict[str, tuple[int, str, tuple[str, str]]]:
    """Predicts and completes by insert productions, least (cost, audit) first, until each item has its least."""
    done: dict[str, tuple[int, str, tuple[str, str]]] = {}
    agenda = [(cost, audit, x, back) for x, (cost, audit, back) in scanned.items()]
    heapq.heapify(agenda)
    while agenda:
        cost, audit, x, (parent, letters) = heapq.heappop(agenda)
        if x in done:
            continue
        done[x] = (cost, audit, (parent, letters))
        for left, child, initial in PRODUCTIONS:
            if child == x and initial in GIVEN and left not in done:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", left, (parent, letters + "I")))
    return done


@lru_cache(maxsize=1 << 16)
def advance(column: Column, code: str) -> tuple[Column, int, dict[str, tuple[str, str]]]:
    """The next column behind a row of ``code``, the cost added, and each item's parent and letters.

    Scans the row by deleting it, keeping it, or giving it another role, then completes by inserts. Columns differ in
    few ways, so each is made once.
    """
    scanned: dict[str, tuple[int, str, tuple[str, str]]] = {}

    def offer(left: str, cost: int, audit: str, parent: str, letter: str) -> None:
        if left not in scanned or (cost, audit + letter) < scanned[left][:2]:
            scanned[left] = (cost, audit + letter, (parent, letter))

    late = TRUNCATED if code in CUT_OFF else 0
    for x, cost, audit in column:
        offer(x, cost + DELETE, audit, x, "D")
        if code in INITIALS + CUT_OFF:
            for left, child, initial in PRODUCTIONS:
                if child == x and initial == _PLAIN[code]:
                    offer(left, cost + late, audit, x, "K")
                if child == x and initial in GIVEN:
                    offer(left, cost + REROLE + late, audit, x, "R")
    return _column(_complete(scanned))


def first_column() -> tuple[Column, int, dict[str, tuple[str, str]]]:
    return _column(_complete({START: (0, "", (START, ""))}))


class Parse:
    """One conversation's chart, fed with codes; a row costs one entry. ``edits`` walks the completed chart back."""

    def __init__(self) -> None:
        self.column, self.cost, first = first_column()
        self.backs = [first]
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.before = ""

    def feed(self, codes: str) -> None:
        for code in codes:
            self.column, more, back = advance(self.column, code)
            self.cost += more
            self.backs.append(back)
            self.faults["blank"] += code in BLANK
            self.faults["duplicate"] += code in DUPLICATE
            self.faults["truncated"] += code in CUT_OFF
            self.faults["illegal"] += self.before != "" and self.before + _PLAIN[code] not in _LEGAL
            self.before = _PLAIN[code]

    def edits(self) -> tuple[int, list[str]]:
        """The least cost and, for what stands before the first row and for each row, its edits' initials."""
        cost, _, x = min((cost, tail, x) for x, cost, tail in self.column if x in COMPLETE)
        out = []
        for back in reversed(self.backs):
            x, letters = back[x]
            out.append(letters)
        return self.cost + cost, out[::-1]


def roles_of(letters: Iterable[str], codes: str, state: str = START) -> tuple[list[str], str]:
    """For each letter the role it leaves ("" where the row goes or keeps its own), and the nonterminal reached.

    From each nonterminal only one role that can be given may follow, so the letters say it all.
    """
    code, out = iter(codes), []
    for letter in letters:
        initial = _PLAIN[next(code)] if letter != "I" else ""
        if letter == "D":
            out.append("")
            continue
        wanted = initial if letter == "K" else next(i for _, child, i in PRODUCTIONS if child == state and i in GIVEN)
        state = next(left for left, child, i in PRODUCTIONS if child == state and i == wanted)
        out.append("" if letter == "K" else GIVEN[wanted])
    return out, state


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
_PACK = "k string, part int, seg long, codes string, copies array<long>, turns array<long>, digests array<binary>"
_PARSED = "k string, part int, seg long, state string, audit string, blank long, duplicate long, truncated long, illegal long, cost long"


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    schema = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _spread(code: str, copies: int) -> str:
    """The codes of equal rows: the further ones are duplicates, or as blank as the first."""
    return code + (code if code in BLANK + DUPLICATE else DUPLICATE[INITIALS.index(_PLAIN[code])]) * (copies - 1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted thin rows into rows of up to PACKED rows of one conversation, in order; codes has a letter for each copy."""
    from pyspark import TaskContext

    part, seg, key = TaskContext.get().partitionId(), 0, None
    held: tuple[list, ...] = ([], [], [], [])
    packed = lambda: (key, part, seg, "".join(held[0]), *held[1:])
    for batch in batches:
        rows = []
        for k, code, copies, turn, digest in zip(*(batch.column(c).to_pylist() for c in ("k", "code", "copies", "turn", "digest"))):
            if held[0] and (k != key or len(held[0]) >= PACKED):
                rows.append(packed())
                held, seg = ([], [], [], []), seg + 1
            key = k
            for into, v in zip(held, (_spread(code, copies), copies, turn, digest)):
                into.append(v)
        if rows:
            yield _batch(rows, _PACK)
    if held[0]:
        yield _batch([packed()], _PACK)


def _finished(k: str, parse: Parse, packs: list[tuple[int, int, str]]) -> list[tuple]:
    cost, letters = parse.edits()
    rows, at, state = [], 1, START
    for n, (part, seg, codes) in enumerate(packs):
        own = "".join(letters[at if n else 0 : at + len(codes)])
        rows.append((k, part, seg, state, own, None, None, None, None, None))
        state = roles_of(own, codes, state)[1]
        at += len(codes)
    return [*rows, (k, None, None, None, "".join(letters), *parse.faults.values(), cost)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs, sorted, into one row a pack (its edits, the nonterminal before it) and one row a conversation (facts and audit)."""
    key, parse, packs = None, Parse(), []
    for batch in batches:
        out = []
        for k, part, seg, codes in zip(*(batch.column(c).to_pylist() for c in ("k", "part", "seg", "codes"))):
            if packs and k != key:
                out += _finished(key, parse, packs)
                parse, packs = Parse(), []
            key = k
            parse.feed(codes)
            packs.append((part, seg, codes))
        if out:
            yield _batch(out, _PARSED)
    if packs:
        yield _batch(_finished(key, parse, packs), _PARSED)


_TURNS = "k string, part int, seg long, at long, edit string, role string, turn long, digest binary"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs with their edits into one row for each edit but deletes."""
    for batch in batches:
        for n in range(batch.num_rows):
            p = batch.slice(n, 1).to_pylist()[0]
            source = (n for n, copies in enumerate(p["copies"]) for _ in range(copies))
            rows = []
            for at, (letter, role) in enumerate(zip(p["audit"], roles_of(p["audit"], p["codes"], p["state"])[0])):
                n = next(source) if letter != "I" else None
                if letter != "D":
                    rows.append((p["k"], p["part"], p["seg"], at, letter, role or None, *((None, None) if n is None else (p["turns"][n], p["digests"][n]))))
            if rows:
                yield _batch(rows, _TURNS)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of rows (conv_id, turn, role, text), and how often each row stands there if a column copies says so.

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, of those that have rows. turns:
    conv_id, part, seg, at, edit (K, R or I), role, text: the repaired rows, in order of part, seg and at.

    Rows stand in order of turn (nulls first), role and the SHA-256 of role and text; equal rows count as repeats.
    An Earley parse over the roles' initials, with productions that delete, rerole and insert, keeps the least (cost,
    audit) of each chart item.

    A conversation may hold any share of all rows. Rows that repeat are counted with map-side combine; thin rows
    (a digest in place of the text) are sorted by ranges of conversation and turn, so that a long conversation lies in
    many tasks, and packed to one letter a row. Only these letters meet in one task, as the audit does in one
    value; the edits go back to where the rows lie, and only rows that stay are joined to their texts.

    Null roles and texts count as one blank, null ids as a conversation of their own. An empty role has no initial and
    can't be kept. Other columns are ignored. Very long texts are digested and moved once for the join, never held
    with others. Empty table: both results are empty.
    """
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    whole = rows.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("k"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies")).where("copies > 0")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    last = F.right(F.btrim("text", F.lit(BLANKS)), F.lit(1))
    kind = F.when(last == "", F.lit(BLANK)).when(last.isin(".", "!", "?"), F.lit(INITIALS)).otherwise(F.lit(CUT_OFF))
    initial = F.substring("role", 1, 1)
    place = F.when((initial != "") & initial.isin("s", "u", "a"), F.instr(F.lit(INITIALS), initial)).otherwise(len(INITIALS))
    thin = whole.select("k", "turn", "role", digest.alias("digest"), F.substring(kind, place, F.lit(1)).alias("code"), "copies")
    # One row for each of equal rows, however many, and the first turn of each role and text.
    thin = cut(thin.groupBy("k", "turn", "role", "digest", "code").agg(F.sum("copies").alias("copies")))
    before = -(1 << 63)
    order = F.coalesce("turn", F.lit(before))
    again = thin.groupBy("k", "digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = thin.alias("t").join(cut(again).alias("a"), (F.col("t.k") == F.col("a.k")) & (F.col("t.digest") == F.col("a.digest")), "left")
    repeated = F.col("a.first").isNotNull() & (order > F.col("a.first")) & ~F.col("code").isin(*BLANK)
    code = F.when(repeated, F.substring(F.lit(DUPLICATE), F.instr(F.lit(INITIALS), F.lower("code")), F.lit(1))).otherwise(F.col("code"))
    known = known.select("t.k", "t.turn", "t.role", "t.digest", code.alias("code"), "t.copies")
    ordered = known.repartitionByRange("k", order, "role", "digest").sortWithinPartitions("k", F.col("turn").asc_nulls_first(), "role", "digest")
    # Written once: the ranges are drawn from a sample, and the edits must meet the packs they were made for.
    packs = cut(ordered.mapInArrow(_pack, _PACK))
    parsed = packs.select("k", "part", "seg", "codes").repartition("k").sortWithinPartitions("k", "part", "seg").mapInArrow(_parse, _PARSED)
    parsed = cut(parsed)
    edits = packs.join(parsed.where("cost is null").select("k", "part", "seg", "state", "audit"), ["k", "part", "seg"]).mapInArrow(_edited, _TURNS)
    edits = cut(edits)
    texts = whole.select("k", "turn", "role", "text").distinct().withColumn("digest", digest).alias("w")
    e = edits.where("edit <> 'I'").alias("e")
    same = (F.col("e.k") == F.col("w.k")) & F.col("e.turn").eqNullSafe(F.col("w.turn")) & (F.col("e.digest") == F.col("w.digest"))
    at = [F.col(f"e.{c}") for c in ("k", "part", "seg", "at", "edit")]
    kept = e.join(texts, same).select(*at, F.coalesce("e.role", "w.role").alias("role"), F.col("w.text").alias("text"))
    turns = kept.unionByName(edits.where("edit = 'I'").select("k", "part", "seg", "at", "edit", "role", F.lit("").alias("text")))
    ids = whole.groupBy("k").agg(F.first("conv_id").alias("conv_id"))
    spans = thin.select("k", "turn").distinct().groupBy("k").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    facts = parsed.where("cost is not null").join(spans, "k").join(ids, "k")
    facts = facts.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    back = F.when(F.col("k") != " ", F.col("k")).cast(rows.schema["conv_id"].dataType).alias("conv_id")
    return facts, turns.select(back, "part", "seg", "at", "edit", "role", "text")


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in, by crc32 of ``conv_id:turn`` modulo 20 (null: one blank); copies: how often a row stands there.

    0: gone; 1: no text; 2: without its ``.``, ``!`` and ``?``; 3: twice; 4: of role user. Null roles and texts: one blank.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


_HASHED = "k string, repaired_sha256 string"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns into a digest a conversation, a text at a time."""
    key, h = None, None
    for batch in batches:
        out = []
        for k, role, text in zip(*(batch.column(c) for c in ("k", "role", "text"))):
            if h is None or k.as_py() != key:
                out += [] if h is None else [(key, h.hexdigest())]
                key, h = k.as_py(), hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(role.as_py().encode() + b":")
            h.update(text.as_py().encode())
        if out:
            yield _batch(out, _HASHED)
    if h is not None:
        yield _batch([(key, h.hexdigest())], _HASHED)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of each conversation's ``role:text``, joined by newlines.

    A conversation's digest takes its texts in order, so they pass through one task, one at a time and sorted on disk where need be.
    """
    k = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("k")
    flat = turns.select(k, "part", "seg", "at", "role", "text").repartition("k").sortWithinPartitions("k", "part", "seg", "at")
    out = flat.select("k", "role", "text").mapInArrow(_hashed, _HASHED)
    return out.select(F.when(F.col("k") != " ", F.col("k")).cast(turns.schema["conv_id"].dataType).alias("conv_id"), "repaired_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    facts, turns = repair(damage(rows))
    ids, f, d = rows.select("conv_id").distinct().alias("i"), facts.alias("f"), digests(turns).alias("d")
    out = ids.join(f, F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left").join(d, F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("i.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_CRC_TABLE = """(SELECT list(list_reduce([i] || range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tbl FROM range(256) r(i))"""


def _sql_step() -> str:
    """A row's step over the four places a parse can be at (t: start, s: system, u: user, a: assistant), as nine digits of cost and the audit."""
    add = lambda v, cost, letter: f"lpad((left({v}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({v}, 10) || '{letter}'"
    keeps = lambda v, initial: f"CASE WHEN NOT must_go AND initial = '{initial}' THEN {add(v, 'late', 'K')} END"
    given = lambda v: f"CASE WHEN NOT must_go THEN {add(v, '3 + late', 'R')} END"
    u = ", ".join(f"{keeps(v, 'u')}, {given(v)}" for v in "tsa")
    scanned = f"""SELECT conv, pos, {add('t', 4, 'D')} AS t, least({add('s', 4, 'D')}, {keeps('t', 's')}) AS s,
      least({add('u', 4, 'D')}, {u}) AS u, least({add('a', 4, 'D')}, {keeps('u', 'a')}, {given('u')}) AS a
      FROM (SELECT r.conv, r.pos, t, s, u, a, r.initial, r.must_go, CASE WHEN r.truncated THEN 3 ELSE 0 END AS late FROM chart c JOIN r ON r.conv = c.conv AND r.pos = c.pos + 1)"""
    return f"SELECT conv, pos, t, s, u, least(a, {add('u', 3, 'I')}) AS a FROM (SELECT conv, pos, t, s, least(u, {add('t', 3, 'I')}, {add('s', 3, 'I')}, {add('a', 3, 'I')}) AS u, a FROM ({scanned}))"


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS conv,
         xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
             lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM conversations, {_CRC_TABLE}
), e AS (
  SELECT conv, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, range(CASE fate WHEN 3 THEN 2 ELSE 1 END) WHERE fate <> 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS pos FROM e
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS repeated,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, left(role, 1) AS initial FROM p
), r AS (
  SELECT *, last = '' AS blank, last <> '' AND repeated AS duplicate, last <> '' AND NOT repeated AND last NOT IN ('.', '!', '?') AS truncated,
         last = '' OR repeated AS must_go, lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM o
), chart AS (
  SELECT DISTINCT conv, 0::BIGINT AS pos, '000000000' AS t, NULL::VARCHAR AS s, '000000003I' AS u, '000000006II' AS a FROM r
  UNION ALL
  {_sql_step()}
), best AS (
  SELECT conv, least(t, a) AS v FROM chart JOIN (SELECT conv, max(pos) AS pos FROM r GROUP BY conv) USING (conv, pos)
), l AS (
  SELECT conv, ord, letter, (sum((letter <> 'I')::INT) OVER w)::BIGINT AS pos, (sum((letter <> 'D')::INT) OVER w)::BIGINT AS symbol
  FROM (SELECT conv, unnest(string_split(substr(v, 10), '')) AS letter, generate_subscripts(string_split(substr(v, 10), ''), 1) AS ord FROM best)
  WHERE letter <> '' WINDOW w AS (PARTITION BY conv ORDER BY ord)
), m AS (
  SELECT l.conv, ord, letter, symbol, r.role, r.text, max((letter = 'K' AND symbol = 1 AND r.initial = 's')::INT) OVER (PARTITION BY l.conv) AS system
  FROM l LEFT JOIN r ON r.conv = l.conv AND r.pos = l.pos AND letter <> 'I' WHERE letter <> 'D'
), h AS (
  SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (symbol - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || coalesce(text, ''), chr(10) ORDER BY ord)) AS digest FROM m GROUP BY conv
), f AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM r GROUP BY conv
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(left(v, 9)::BIGINT, 0) AS cost, coalesce(substr(v, 10), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM d) i LEFT JOIN f USING (conv) LEFT JOIN best USING (conv) LEFT JOIN h USING (conv)
"""
