"""Operator 11: exact BPE by dynamic programming over prefixes."""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm.bpe import byte_chars
from mailgauge.llm.common import table

NAME = "byte_bpe_50k.json"
#: The pre-token pattern of byte-level tokenizers with ``use_regex`` (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside these ranges the Unicode versions of the regex module and of the tokenizers library may differ on what a
#: letter is; a text with other characters is split by the library's own pre-tokenizer. A test compares all characters.
AGREED = r"\x00-ԯḀ-⁮₠-₿℀-⅏←-⯿　-ㄮ㐀-龥가-힣！-ﾟ\U0001F300-\U0001F64F"
#: Pre-tokens of under SHORT bytes, and pairs of tokens, that a worker keeps the answers of. When full of pairs, it
#: starts anew; when full of pre-tokens, it sets them aside and takes back those that come again until it is full again.
KEPT, PAIRS, SHORT = 100_000, 500_000, 64
#: Prefixes of such pre-tokens that a worker keeps the last tokens of; when full, it starts anew.
PREFIXES = 1_000_000
#: Steps of the automaton that a worker keeps.
STEPS = 300_000
#: Texts of more characters are split as an iterator, not into a list.
LONG = 1 << 20
#: Documents whose ids are in a worker's memory at once.
SLICE = 256
_NEVER = 1 << 60


class SuffixAutomaton:
    """Which of ``words`` end at each byte of a text, longest first.

    A state stands for all strings that end at the same places within the words; it is built breadth first over the
    words' trie. ``ends`` has a state's words that are suffixes of its longest string.
    """

    def __init__(self, words: Iterable[tuple[bytes, int]]):
        root: dict = {}
        for word, ident in words:
            node = root
            for b in word:
                node = node.setdefault(b, {})
            node[-1] = ident
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, int] = {}
        todo = deque([(root, 0)])
        while todo:
            node, state = todo.popleft()
            for b, below in node.items():
                if b < 0:
                    own[state] = below
                else:
                    todo.append((below, self._extend(state, b)))
        self.steps: dict[int, tuple] = {}
        self.ends: list[tuple[int, ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.ends[self.link[s]]
            self.ends[s] = (own[s], *up) if s in own else up

    def step(self, state: int, byte: int) -> tuple[int, int, int, tuple[int, ...], tuple[int, ...]]:
        """From ``state`` over ``byte``: the next state; how much then matches, 0 for one byte more; the next state's length; words that end there if all of it matches, else."""
        at, matched = state, 0
        while byte not in self.next[at]:
            at = self.link[at]
            if at < 0:
                raise ValueError(f"byte {byte} isn't in the vocabulary")
            matched = self.length[at] + 1
        to = self.next[at][byte]
        if len(self.steps) >= STEPS:
            self.steps.clear()
        got = self.steps[state << 8 | byte] = to, matched, self.length[to], self.ends[to], self.ends[self.link[to]]
        return got

    def _extend(self, state: int, byte: int) -> int:
        """The new state of the string of ``state`` and one more byte, a path of the trie that no string before held."""
        new, p = self._state({}, self.length[state] + 1, 0), state
        while p >= 0 and byte not in self.next[p]:
            self.next[p][byte] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.next[p][byte]
        if self.length[q] > self.length[p] + 1:  # the shorter strings of q end at more places from now on
            part = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
            self.link[q] = part
            while p >= 0 and self.next[p].get(byte) == q:
                self.next[p][byte] = part
                p = self.link[p]
            q = part
        self.link[new] = q
        return new

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1


class Vocabulary:
    """The pieces and merges of a byte-level BPE file, and which pairs of tokens stand side by side in an encoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, split = whole["model"], whole["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or whole["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        back = {ord(c): b for b, c in enumerate(byte_chars())}
        as_bytes = lambda piece: piece.translate(back).encode("latin-1")
        ids = {as_bytes(p): i for p, i in model["vocab"].items()}
        self.bytes = {i: b for b, i in ids.items()}
        #: Texts of added tokens, which are found before anything else; longer ones first.
        self.added = {t["content"]: t["id"] for t in sorted(whole.get("added_tokens", ()), key=lambda t: -len(t["content"]))}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in whole.get("added_tokens", ())):
            raise ValueError(f"{path}: added tokens that take in their neighbours aren't supported")
        self.bytes.update({i: t.encode() for t, i in self.added.items()})
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = (as_bytes(p) for p in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, made = (ids[a], ids[b]), ids[a + b]
            late = [p for p in pair if p not in self.parts and len(self.bytes[p]) > 1]
            if made in self.parts or late:
                raise ValueError(f"{path}: each piece must have one merge, after those of its parts")
            self.rank[pair], self.parts[made] = r, pair
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}  # by first token << 32 | second token
        sound = {i for i, b in self.bytes.items() if len(b) == 1}
        for made, (a, b) in self.parts.items():
            if a in sound and b in sound and self.crossing(a, b) == self.rank[a, b]:
                sound.add(made)
        #: Tokens whose own bytes encode to them alone.
        self.sound = sound
        self.sizes = {i: len(b) for i, b in self.bytes.items()}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that ``token``'s last (side 1) or first (side 0) byte belongs to in turn, each with the rank of the merge that ends it."""
        got = self.edges[side].get(token)
        if got is None:
            got, until, piece = [], _NEVER, token
            while True:
                got.append((piece, until))
                if piece not in self.parts:
                    break
                until, piece = self.rank[self.parts[piece]], self.parts[piece][side]
            self.edges[side][token] = got
        return got

    def crossing(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of ``a`` and ``b`` when their bytes are merged as one text; _NEVER if none is.

        Two pieces at the border merge if both are still there at their merge's rank. Of equal merges the left one
        comes first: so the left piece must not end by a merge of the same rank, the right one may.
        """
        first = _NEVER
        for x, until_x in self.edge(a, 1):
            for y, until_y in self.edge(b, 0):
                r = self.rank.get((x, y), _NEVER)
                if r < first and r < until_x and r <= until_y:
                    first = r
        return first

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together encode to these two tokens."""
        got = self.pairs.get(a << 32 | b)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[a << 32 | b] = self.crossing(a, b) == _NEVER
        return got


@lru_cache(maxsize=1)
def _pattern() -> re.Pattern:
    """PATTERN over the characters of AGREED, with its classes written out: the standard module searches these faster."""
    agreed = "".join(regex.findall(f"[{AGREED}]", "".join(chr(o) for o in range(0x110000) if not 0xD800 <= o < 0xE000)))
    written = lambda c: "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in _runs(regex.findall(c, agreed)))
    space, letter, number = written(r"\s"), written(r"\p{L}"), written(r"\p{N}")
    text = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return re.compile(text.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


def _runs(chars: list[str]) -> list[list[str]]:
    """Ascending characters, cut where one isn't the next of the one before."""
    runs: list[list[str]] = []
    for c in chars:
        if runs and ord(c) == ord(runs[-1][-1]) + 1:
            runs[-1].append(c)
        else:
            runs.append([c])
    return runs


class _Kept(dict):
    """Answers by question; what isn't there is asked of ``answer``, which may keep it here."""

    def __init__(self, answer: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.answer = answer

    def __missing__(self, question: str) -> tuple[int, ...]:
        return self.answer(question)


class Prefixes:
    """The prefixes of short pre-tokens met so far, a trie: of each its last token and where the automaton stands after it."""

    def __init__(self):
        self.below: dict[int, int] = {}  # by prefix and next byte
        self.token, self.state, self.matched = [-1], [0], [0]

    def clear(self) -> None:
        self.below.clear()
        for column in (self.token, self.state, self.matched):
            del column[1:]


class Codec:
    """Encodes texts as the tokenizers library does, and decodes ids."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.automaton = SuffixAutomaton((v.bytes[i], i) for i in v.sound)
        self.path = path
        self.pattern = _pattern()
        self.other = regex.compile(f"[^{AGREED}]").search
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, v.added)) + ")").split if v.added else lambda t: [t]
        self.library = None
        self.kept, self.aside = _Kept(self.pre_token), {}
        self.prefixes = Prefixes()
        self.decimals = {i: str(i) for i in v.bytes}

    def prefix_tokens(self, data: bytes) -> list[int]:
        """The last token of the encoding of each prefix of ``data``.

        An encoding cut after any token is the encoding of the bytes up to there. So a prefix's last token is the one
        among the tokens that end there that stands alone or is compatible with the last token before it; it is unique.
        It depends on that prefix alone, so those of prefixes met before are looked up.
        """
        seen = self.prefixes
        below, tokens, at, last = seen.below, seen.token, 0, []
        for byte in data:
            longer = below.get(at << 8 | byte)
            if longer is None:
                break
            at = longer
            last.append(tokens[at])
        else:
            return last
        state, matched, keep = seen.state[at], seen.matched[at], len(data) < SHORT
        if keep and len(below) + len(data) > PREFIXES:
            seen.clear()
            keep = False  # its shorter prefixes are gone
        step, steps = self.automaton.step, self.automaton.steps.get
        sizes, known, compatible = self.vocabulary.sizes, self.vocabulary.pairs.get, self.vocabulary.compatible
        for n, byte in enumerate(data[len(last) :], len(last) + 1):
            state, reset, length, whole, part = steps(state << 8 | byte) or step(state, byte)
            matched = reset or matched + 1
            for token in whole if matched == length else part:
                before = n - sizes[token]
                if before:
                    fits = known(last[before - 1] << 32 | token)
                    if not (compatible(last[before - 1], token) if fits is None else fits):
                        continue
                last.append(token)
                if keep:
                    below[at << 8 | byte] = at = len(tokens)
                    tokens.append(token)
                    seen.state.append(state)
                    seen.matched.append(matched)
                break
        return last

    def pre_token(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token: back over the last tokens of its prefixes."""
        got = self.kept.get(word)
        if got is not None:
            return got
        got, short = self.aside.get(word), True
        if got is None:
            data = word.encode()
            last, sizes, at, back = self.prefix_tokens(data), self.vocabulary.sizes, len(data), []
            while at:
                token = last[at - 1]
                back.append(token)
                at -= sizes[token]
            back.reverse()
            got, short = tuple(back), len(data) < SHORT
        if short:
            if len(self.kept) >= KEPT:
                self.aside = dict(self.kept)
                self.kept.clear()
            self.kept[word] = got
        return got

    def pre_tokens(self, text: str) -> Iterable[str]:
        if self.other(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
            return (text[a:b] for _, (a, b) in self.library(text))
        return self.pattern.findall(text) if len(text) < LONG else (m.group() for m in self.pattern.finditer(text))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.split_added(text)):
            if k % 2:
                ids.append(self.vocabulary.added[part])
            else:
                ids.extend(chain.from_iterable(map(self.kept.__getitem__, self.pre_tokens(part))))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``; bytes that aren't UTF-8 become U+FFFD, and ids without a piece vanish."""
        known = self.vocabulary.bytes
        return b"".join([b for b in map(known.get, ids) if b is not None]).decode("utf-8", "replace")

    def row(self, text: str, rows: dict[str, list]) -> None:
        """Appends what the fields of ``rows`` ask for about one text."""
        ids = self.encode(text)
        decoded = self.decode(ids) if "decoded" in rows or "decoded_sha256" in rows else ""
        for field, into in rows.items():
            if field == "ids":
                into.append(np.array(ids, np.int32))
            elif field == "n_tokens":
                into.append(len(ids))
            elif field == "ids_sha256":
                into.append(hashlib.sha256(",".join(map(self.decimals.__getitem__, ids)).encode()).hexdigest())
            else:
                into.append(decoded if field == "decoded" else hashlib.sha256(decoded.encode()).hexdigest())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


_FIELDS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
_ARROW = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string()}


def encode_documents(docs: DataFrame, path: str, fields: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``docs`` plus ``bpe``: a struct of ``fields`` of column text; null counts as empty.

    The fields: ids; n_tokens; ids_sha256, of the decimal ids joined by commas; decoded, the text that the ids decode
    to; decoded_sha256. ``path``: a tokenizer file of the tokenizers library, which every executor has.

    Row by row, without a shuffle. Time and memory are linear in a text, with however long runs of one kind of
    character; a worker holds the ids of SLICE documents at a time. Repeated rows get equal results. A column
    ``bpe`` of the input is replaced; other columns, null ids among them, pass through. An empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for texts in batches:
            for at in range(0, len(texts), SLICE):
                rows: dict[str, list] = {f: [] for f in fields}
                for t in texts.slice(at, SLICE):
                    c.row(t.as_py() or "", rows)
                yield pa.StructArray.from_arrays([pa.array(rows[f], _ARROW[_FIELDS[f]]) for f in fields], names=list(fields))

    return docs.withColumn("bpe", F.arrow_udf(run, ", ".join(f"{f} {_FIELDS[f]}" for f in fields))("text"))


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path(NAME), ("n_tokens", "ids_sha256", "decoded_sha256")).select("doc_id", "bpe.*")
