"""Byte-level BPE encoding and decoding through a sentencepiece BPE model built from a rank file.

The model is written as protobuf bytes straight from the vocabulary: each token's bytes become letters
(byte b is the letter U+0100 + b), its score is the negative rank, and the normaliser leaves text alone. sentencepiece then
merges the pair of best score first and the leftmost of equals, which is the byte-level rule "lowest rank first".

Edge cases: null or empty text has no ids (the hash is that of no bytes); a pre-token that is itself in the vocabulary
is one id; ids that the vocabulary lacks are refused when decoding. Repeated rows come out once each; very long texts are encoded
whole, and their distinct pre-tokens beyond CACHE_CHARS are not remembered; an empty table gives no rows; columns that are not kept
aren't read, whatever their names. Of two merges of one score the leftmost comes first.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from tallyloom.llm.arrow_text import column, map_text, texts

#: Distinct pre-tokens whose ids a worker remembers, and the longest that it remembers.
CACHE_ENTRIES = 100_000
CACHE_CHARS = 64
#: \s as Unicode's White_Space property, which is what the rule's usual library takes it for.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank, a line each), by rank; ranks must be 0, 1, 2, ..."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    tokens = [ranks.get(i) for i in range(len(ranks))]
    if any(t is None for t in tokens):
        raise ValueError(f"{path}: ranks are not 0..{len(ranks) - 1}")
    return tokens


def _letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_LETTER)


def _bytes(piece: str) -> bytes:
    """The inverse of _letters."""
    return bytes(ord(c) - 0x100 for c in piece)


_LETTER = {b: chr(0x100 + b) for b in range(256)}


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces in rank order with score -rank, then the unknown piece that the library wants."""
    # Field numbers and enum values of sentencepiece_model.proto.
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, _letters(t).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(i)) + _flag(3, normal)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, unknown)))
    trainer = _field(2, _flag(3, bpe) + _flag(4, len(pieces)) + _flag(40, len(tokens)))
    normaliser = _field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))
    return b"".join(pieces) + trainer + normaliser


class Codec:
    """Encodes and decodes texts with one model; keeps a bounded memory of pieces already seen."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.pieces = [_bytes(self.model.id_to_piece(i)) for i in range(len(tokens))]
        exact = pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]")
        self.pretokens = regex.compile(exact)
        self.known: dict[str, tuple[int, ...]] = {}
        self.said: dict[str, str] = {}

    def _learn(self, pretokens: set[str]) -> None:
        """Ids of unseen pre-tokens, in one call of the model."""
        odd, number = [], range(len(self.pieces))
        for pre in pretokens:
            one = self.ids.get(pre.encode())
            if one is None:
                odd.append(pre)
            else:
                self.known[pre], self.said[pre] = (one,), str(one)
        for pre, ids in zip(odd, self.model.encode([_letters(p.encode()) for p in odd], out_type=int, num_threads=1), strict=True):
            self.known[pre], self.said[pre] = tuple(map(number.__getitem__, ids)), " ".join(map(str, ids))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """For each text its ids, and their decimals joined by one space."""
        split = [self.pretokens.findall(t) for t in texts]
        distinct = set().union(*split)
        if len(self.known) + len(distinct) > CACHE_ENTRIES:
            self.known.clear()
            self.said.clear()
        self._learn(distinct.difference(self.known))
        for pretokens in split:
            yield list(chain.from_iterable(map(self.known.__getitem__, pretokens))), " ".join(map(self.said.__getitem__, pretokens))
        for pre in distinct:
            if len(pre) > CACHE_CHARS:
                del self.known[pre], self.said[pre]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))[0]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for: the inverse of the byte mapping over each piece."""
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(packed: bytes, pattern: str) -> Codec:
    tokens, at = [], 0
    while at < len(packed):
        n = packed[at] | packed[at + 1] << 8
        tokens.append(packed[at + 2 : at + 2 + n])
        at += 2 + n
    return Codec(tokens, pattern)


def _pack(tokens: list[bytes]) -> bytes:
    return b"".join(len(t).to_bytes(2, "little") + t for t in tokens)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep: list[str] | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs(keep...) with `ids` (array<int>), their number, and digests of the ids and of the decoded bytes.

    The vocabulary file is read on the driver and broadcast (a vocabulary is bounded, a megabyte here).
    """
    keep = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(_pack(read_ranks(vocabulary)))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_tokens bigint", "ids array<int>", "ids_sha256 string", "decoded_sha256 string"])

    def rows(part: pa.RecordBatch) -> dict:
        codec = _codec(shared.value, pattern)
        out = {c: column(part, c) for c in keep} | {"n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
        for ids, said in codec.encode_all(texts(part, text)):
            out["n_tokens"].append(len(ids))
            out["ids"].append(ids)
            out["ids_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return out

    return map_text(docs, keep, schema, rows, text)


def token_digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the ids themselves stay in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(_pack(read_ranks(vocabulary)))
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> dict:
        codec = _codec(shared.value, pattern)
        out = {id_col: column(part, id_col), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids, said in codec.encode_all(texts(part, text)):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return out

    return map_text(docs, [id_col], f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows, text)


def decode_ids(frame: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """id_col and `text` of each array of ids; bytes that are no UTF-8 become U+FFFD."""
    shared = frame.sparkSession.sparkContext.broadcast(_pack(read_ranks(vocabulary)))
    kind = frame.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(shared.value, pattern)
        for b in batches:
            said = [codec.decode(x or []).decode("utf-8", "replace") for x in column(b, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, id_col), pa.array(said, pa.string())], names=[id_col, "text"])

    return frame.select(id_col, ids).mapInArrow(run, f"`{id_col}` {kind}, text string")
