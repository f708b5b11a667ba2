"""Operator 10: byte-level BPE by way of a sentencepiece model made from a rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm.common import table

#: Distinct pre-tokens, of under 64 bytes, that a Python worker keeps the ids of; when it is full, it starts anew.
KEPT = 50_000
#: Documents whose ids are in a worker's memory at once.
SLICE = 256
NAME = "byte_bpe_50k.tiktoken"


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where Latin-1 has one, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: each byte string as byte characters, score minus its rank, identity normalisation.

    A piece's id is its rank; one unknown piece, which no text of byte characters meets, follows the last.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars, m = byte_chars(), pb.ModelProto()
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        m.pieces.add(piece="".join(chars[b] for b in piece), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    m.trainer_spec.model_type = pb.TrainerSpec.BPE
    m.trainer_spec.vocab_size = len(m.pieces)
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = len(ranks), -1, -1, -1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.remove_extra_whitespaces = m.normalizer_spec.escape_whitespaces = False
    return m.SerializeToString()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes pre-tokens, the matches of ``pattern``, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        assert sorted(ranks.values()) == list(range(len(ranks))), "ranks must be 0 to n - 1"
        self.find = regex.compile(pattern).findall
        self.chars = {b: ord(c) for b, c in enumerate(byte_chars())}
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        # The inverse mapping: an id's piece in the model, its characters' bytes.
        back = {c: b for b, c in self.chars.items()}
        self.bytes = [self.sp.id_to_piece(i).translate(back).encode("latin-1") for i in range(len(ranks))]
        self.whole = {piece: i for i, piece in enumerate(self.bytes)}
        self.kept: dict[str, tuple[int, ...]] = {}

    def piece(self, word: str) -> tuple[int, ...]:
        got = self.kept.get(word)
        if got is None:
            raw = word.encode("utf-8", "surrogatepass")
            # A pre-token that is itself a piece: the model gives that piece too, as tests check for all of them.
            rank = self.whole.get(raw)
            got = (rank,) if rank is not None else tuple(self.sp.encode(raw.decode("latin-1").translate(self.chars), num_threads=1))
            if len(self.kept) >= KEPT:
                self.kept.clear()
            if len(raw) < 64:
                self.kept[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        piece = self.piece
        return [i for w in self.find(text) for i in piece(w)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def row(self, text: str, rows: dict[str, list]) -> None:
        """Appends what the fields of ``rows`` ask for about one text."""
        ids = self.encode(text)
        decoded = self.decode(ids) if "decoded" in rows or "decoded_sha256" in rows else b""
        for field, into in rows.items():
            if field == "ids":
                into.append(np.array(ids, np.int32))
            elif field == "n_tokens":
                into.append(len(ids))
            elif field == "ids_sha256":
                into.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            else:
                into.append(decoded if field == "decoded" else hashlib.sha256(decoded).hexdigest())


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


_FIELDS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}
_ARROW = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def encode_documents(docs: DataFrame, path: str, pattern: str, fields: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``docs`` plus ``bpe``: a struct of ``fields`` of column text; null counts as empty.

    The fields: ids; n_tokens; ids_sha256, of the decimal ids joined by a blank; decoded, the bytes that the ids
    decode to; decoded_sha256. Digests are made where the ids are, so that ids and bytes needn't leave the worker.

    Row by row, without a shuffle; a worker builds the model once from the rank file, which every executor
    has, and holds the ids of SLICE documents at a time. Repeated rows get equal results. A column ``bpe`` of
    the input is replaced; other columns pass through. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for texts in batches:
            for at in range(0, len(texts), SLICE):
                rows: dict[str, list] = {f: [] for f in fields}
                for t in texts.slice(at, SLICE):
                    c.row(t.as_py() or "", rows)
                yield pa.StructArray.from_arrays([pa.array(rows[f], _ARROW[_FIELDS[f]]) for f in fields], names=list(fields))
        c.kept.clear()

    return docs.withColumn("bpe", F.arrow_udf(run, ", ".join(f"{f} {_FIELDS[f]}" for f in fields))("text"))


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(NAME), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, *public_vocabulary(), ("n_tokens", "ids_sha256", "decoded_sha256")).select("doc_id", "bpe.*")
