"""Operator 12 against its SQL, a plain search over all edits, and whole repairs by hand."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from mailgauge.llm import conversations as cv

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def all_edits(rows, state="start"):
    """Every (cost, audit, repaired rows) with at most one insert before and after each row; rows: (initial, role, text, must go, truncated)."""
    after = {("start", "s"): "s", ("start", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    inserts = [(0, "", [], state)]
    for n in (1, 2):
        cost, audit, out, at = inserts[-1]
        role = "assistant" if at == "u" else "user"
        inserts.append((cost + 3, audit + "I", [*out, (role, "")], after[at, role[0]]))
    for cost, audit, out, at in inserts:
        if not rows:
            if at in ("start", "a"):
                yield cost, audit, out
            continue
        initial, role, text, gone, late = rows[0]
        ways = [(4, "D", [], at)]
        if not gone:
            given = "assistant" if at == "u" else "user"
            ways.append((3 + 3 * late, "R", [(given, text)], after[at, given[0]]))
            if (at, initial) in after:
                ways.append((3 * late, "K", [(role, text)], after[at, initial]))
        for c, letter, kept, to in ways:
            for c2, audit2, out2 in all_edits(rows[1:], to):
                yield cost + c + c2, audit + letter + audit2, [*out, *kept, *out2]


def facts(rows):
    """What the contract asks for of one conversation's rows (turn, role, text) in order."""
    seen, out, counts = set(), [], Counter()
    for turn, role, text in rows:
        stripped = text.strip(BLANK)
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        out.append((role[:1], role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit, kept = min(all_edits(out), key=lambda x: x[:2])
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)


def repaired(df):
    conversations, turns = cv.repair(df)
    sha = {r.conv_id: r.repaired_sha256 for r in cv.digests(turns).collect()}
    return {r.conv_id: (*tuple(r)[1:], sha.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in conversations.collect()}


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


def test_random_conversations(spark):
    r = random.Random(7)
    rows = []
    for conv in range(60):
        for _ in range(r.randint(1, 7)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "ustad", "Assistant", "été"])
            rows.append((conv, r.choice([None, 0, 1, 2, 3, 5, 9]), role, r.choice(["Hi.", "ok", "Why? \n", " \t", "", "So!", "a.b", "é.\x0b"])))
    got = repaired(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = {c: facts(ordered([x[1:] for x in rows if x[0] == c])) for c in range(60)}
    assert got == want


def plain(codes):
    """Least (cost, audit) with whole audits in every cell, by relaxing until nothing changes."""

    def close(best):
        changed = True
        while changed:
            changed = False
            for left, child, i in cv.PRODUCTIONS:
                if child in best and i in "ua":
                    c, a = best[child]
                    if left not in best or (c + 3, a + "I") < best[left]:
                        best[left], changed = (c + 3, a + "I"), True
        return best

    best = close({"start": (0, "")})
    for code in codes:
        late, steps = 3 * (code in cv.CUT_OFF), [(x, (c + 4, a + "D")) for x, (c, a) in best.items()]
        for left, child, i in cv.PRODUCTIONS if code in cv.INITIALS + cv.CUT_OFF else ():
            if child in best:
                c, a = best[child]
                steps += [(left, (c + late, a + "K"))] if i == code.lower() else []
                steps += [(left, (c + 3 + late, a + "R"))] if i in "ua" else []
        best = close({x: min(v for y, v in steps if y == x) for x, _ in steps})
    return min(best[x] for x in cv.COMPLETE if x in best)


@pytest.mark.parametrize("alphabet", ["suax", "suaxSUAX", "suaxSUAX01234567", "uUa", "su4", "uu4S", "u", "aA", "0"])
def test_parse_equals_a_plain_search(alphabet):
    r = random.Random(alphabet)
    for _ in range(1500):
        codes = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        parse = cv.Parse()
        parse.feed(codes)
        cost, letters = parse.edits()
        assert (cost, "".join(letters)) == plain(codes), codes
        assert all(len(x.replace("I", "")) == 1 for x in letters[1:])


def test_columns_are_few():
    cv.advance.cache_clear()
    parse = cv.Parse()
    r = random.Random(3)
    parse.feed("".join(r.choice("suaxSUAX0246") for _ in range(200_000)) + "u" * 200_000)
    assert cv.advance.cache_info().currsize < 20_000
    assert len(parse.edits()[1]) == 400_001


def test_one_long_conversation_in_many_tasks(spark, monkeypatch):
    """Nearly all rows in one conversation, in packs of 10 rows, equal to the same rows in one pack."""
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "user", "assistant", "system"]), r.choice([f"text {t}.", f"cut {t}", "Thanks.", ""])) for t in range(3000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")] + [(3, None, "user", "the same")] * 500
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    whole = repaired(df)
    assert whole[2][6] == "KK" and whole[3][1:7] == (0, 499, 1, 499, 4 * 500, "D" * 500)
    codes = []
    seen = set()
    for _, turn, role, text in rows[:3000]:
        codes.append("0" if not text else "4" if (role, text) in seen else role[0] if text.endswith(".") else role[0].upper())
        seen.add((role, text))
    assert whole[1][5:7] == plain("".join(codes))
    monkeypatch.setattr(cv, "PACKED", 10)
    assert repaired(df.repartition(5)) == whole


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = "user" if fate == 4 else s(role), "" if fate == 1 else re.sub("[.!?]", "", s(text)) if fate == 2 else s(text)
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def test_damage_of_nulls(spark, tmp_path):
    """Nulls in every column, conversations that damage empties, other columns; against the contract by hand."""
    r = random.Random(11)
    none = lambda x: None if r.random() < 0.2 else x
    rows = [(none(c % 40), none(r.randint(0, 6)), none(r.choice(["user", "assistant", "system"])), none(r.choice(["A.", "B", "", "C?"]))) for c in range(90)]
    rows = [x for x in rows if x[0] is not None] + [x for x in rows if x[0] is None][:6]
    spark.createDataFrame([(*x, "k", 1) for x in rows], SCHEMA + ", k string, copies_of int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x.conv_id: tuple(x)[1:] for x in cv.op12_conversation_repair(spark, str(tmp_path)).collect()}
    after = damaged(rows)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: facts(ordered([x[1:] for x in after if x[0] == c])) if any(x[0] == c for x in after) else nothing for c in {x[0] for x in rows}}
    assert got == want


def test_empty_table_and_long_text(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert repaired(empty) == {}
    empty.write.parquet(str(tmp_path / "conversations.parquet"))
    assert cv.op12_conversation_repair(spark, str(tmp_path)).count() == 0
    text = "word " * 400_000 + "end." + " " * 300_000
    got = repaired(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "Yes.")], SCHEMA))
    assert got[1][6:] == ("KK", hashlib.sha256(f"user:{text}\nassistant:Yes.".encode()).hexdigest())


def test_turns_are_real_rows(spark):
    rows = [(5, 0, "user", "Why?"), (5, 1, "user", "Now?"), (5, 2, "assistant", "So."), (5, 3, "assistant", "Cut off here"), (5, 4, "user", " ")]
    _, turns = cv.repair(spark.createDataFrame(rows, SCHEMA))
    got = [(r.edit, r.role, r.text) for r in turns.orderBy("part", "seg", "at").collect()]
    assert got == [("K", "user", "Why?"), ("I", "assistant", ""), ("K", "user", "Now?"), ("K", "assistant", "So.")]


def test_equals_its_sql(spark, small, duck):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted(tuple(r) for r in cv.op12_conversation_repair(spark, small).select(columns).collect())
    assert got == sorted(duck.sql(f"select {', '.join(columns)} from ({cv.ORACLE})").fetchall())
