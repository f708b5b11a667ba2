"""Operator 11 against the tokenizers library and a plain merge loop."""

import hashlib
import json
import random

import pytest

from mailgauge.llm import prefix_bpe
from mailgauge.llm.bpe import byte_chars

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(prefix_bpe.NAME)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def codec():
    return prefix_bpe.codec(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library(spark, small, texts, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in prefix_bpe.op11_prefix_bpe(spark, small).collect()}
    want = {}
    for i, t in texts.items():
        ids = ids_of(library, t)
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_pre_tokens_agree_on_all_characters(codec, library):
    """The classes of all characters that the regex module splits by itself are the library's."""
    import regex

    own = regex.compile(f"[{prefix_bpe.AGREED}]").match
    chars = [chr(o) for o in range(0x110000) if not 0xD800 <= o < 0xE000 and own(chr(o))]
    split = library.pre_tokenizer.pre_tokenize_str
    for near in ("a", "1", "!"):
        for at in range(0, len(chars), 500):
            text = "\n".join(near + c for c in chars[at : at + 500])
            assert codec.pattern.findall(text) == [text[a:b] for _, (a, b) in split(text)]


@pytest.mark.parametrize("alphabet", ["ab \n'sétx1€你😀", "aeinorst ", " \t\n\r ", "=-_*", "aA.1", "\0\x1f\x85᠎​ݘ࢏𐞻𐵀", "ΑαЯяªº²½"])
def test_random_texts(codec, library, alphabet):
    r = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        at = r.randint(0, len(text))
        text = r.choice([text, text[:at] + "<|endoftext|>" + text[at:], text + "<|endoftext|><|endoftext|"])
        ids = codec.encode(text)
        assert ids == ids_of(library, text), text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_ids_that_are_no_text(codec, library):
    r = random.Random(4)
    for _ in range(300):
        ids = [r.randrange(50_257) for _ in range(r.randint(0, 9))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_runs_take_linear_time(codec, library):
    for text in ("ab" * 200_000, " " * 300_000, "a" * 400_000 + "\n" * 5, "é" * 100_000, "word " * 300_000):
        assert codec.encode(text) == ids_of(library, text)


def test_known_prefixes_are_looked_up():
    """Prefixes met before need neither the automaton nor pair tests; those of long runs aren't kept."""
    c = prefix_bpe.Codec(PATH)
    last = c.prefix_tokens(b" thonwhthinouor")
    c.prefix_tokens(b"ab" * 5000)
    kept = len(c.prefixes.below)
    c.automaton = None
    assert all(c.prefix_tokens(b" thonwhthinouor"[:n]) == last[:n] for n in range(16)) and kept == 15


def test_small_memories(library, monkeypatch):
    """Ids don't depend on how much a worker keeps, nor on what it met before."""
    for name, n in (("KEPT", 5), ("PREFIXES", 60), ("STEPS", 20), ("PAIRS", 10)):
        monkeypatch.setattr(prefix_bpe, name, n)
    c, r = prefix_bpe.Codec(PATH), random.Random(11)
    for _ in range(600):
        text = " ".join("".join(r.choice(("th", "ing", "ou", "er", "é", "7", "'s", "=", "a")) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 6)))
        assert c.encode(text) == ids_of(library, text), text
        assert len(c.kept) <= 5 and len(c.aside) <= 5 and len(c.prefixes.below) <= 60 and len(c.prefixes.token) == len(c.prefixes.below) + 1
        assert len(c.automaton.steps) <= 20 and len(c.vocabulary.pairs) <= 10


def merged(data, ids, rank, made):
    """BPE by merging the first lowest pair until none is left."""
    out = [ids[bytes([b])] for b in data]
    while True:
        found = min(((rank[p], k) for k, p in enumerate(zip(out, out[1:])) if p in rank), default=None)
        if found is None:
            return out
        k = found[1]
        out[k : k + 2] = [made[out[k], out[k + 1]]]


def test_small_vocabularies(tmp_path):
    """Merges drawn at random, pieces that no text gives among them."""
    chars = byte_chars()
    for seed in range(40):
        r = random.Random(seed)
        vocab, merges = {c: k for k, c in enumerate(chars)}, []
        pool = [chars[b] for b in b"abc"]
        while len(merges) < 25:
            a, b = r.choice(pool), r.choice(pool)
            if a + b not in vocab and len(a + b) < 9:
                merges.append([a, b])
                vocab[a + b] = len(vocab)
                pool.append(a + b)
        path = tmp_path / f"{seed}.json"
        path.write_text(json.dumps({"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": [], "model": {"type": "BPE", "vocab": vocab, "merges": merges}}))
        c = prefix_bpe.Codec(str(path))
        ids = {b: i for i, b in c.vocabulary.bytes.items()}
        made = {p: t for t, p in c.vocabulary.parts.items()}
        for _ in range(200):
            text = "".join(r.choice("abc") for _ in range(r.randint(1, 30)))
            want = merged(text.encode(), ids, c.vocabulary.rank, made)
            assert c.encode(text) == want
            last = c.prefix_tokens(text.encode())
            assert all(last[n - 1] == merged(text[:n].encode(), ids, c.vocabulary.rank, made)[-1] for n in range(1, len(text) + 1))


def test_files_it_cannot_follow(tmp_path):
    path = tmp_path / "other.json"
    model = {"type": "BPE", "vocab": {}, "merges": [], "ignore_merges": True}
    path.write_text(json.dumps({"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": model}))
    with pytest.raises(ValueError, match="not a plain"):
        prefix_bpe.Codec(str(path))


def test_odd_rows(odd, empty, library):
    out = prefix_bpe.encode_documents(odd.withColumnRenamed("key", "bpe"), PATH)
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns == [*[c for c in odd.columns if c != "key"][:5], "bpe", *odd.columns[6:]]
    assert all(list(r.bpe.ids) == ids_of(library, r.text or "") and r.bpe.decoded == (r.text or "") for r in rows)
    assert prefix_bpe.encode_documents(empty, PATH).count() == 0
