"""Operator 1: byte-level BPE encoding and decoding by a sentencepiece model that is written straight from a rank file.

Each rank becomes a piece: its bytes mapped to printable characters, its score the negative rank, so that
sentencepiece merges in rank order. No normalisation, no dummy prefix, no space escaping. Pre-tokens are encoded one
by one; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, map_arrow, record_batch, slices, texts


@functools.cache
def byte_characters() -> list[str]:
    """A printable character for each byte: visible Latin-1 stands for itself, the rest follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in rank order."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes are length-delimited, floats 32-bit, integers varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(scored: list[tuple[str, float]]) -> bytes:
    """A sentencepiece ModelProto (type BPE) with a piece id per (piece, score) in order; one unknown piece follows them."""
    pieces = [_field(1, piece.encode()) + _field(2, score) + _field(3, 1) for piece, score in scored]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(scored))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, piece) for piece in pieces) + _field(2, trainer) + _field(3, normaliser)


def serialise_model(tokens: list[bytes]) -> bytes:
    """The model of a rank file: byte-mapped pieces, scored by negative rank, their ids the ranks."""
    chars = byte_characters()
    return serialise([("".join(chars[b] for b in token), float(-rank)) for rank, token in enumerate(tokens)])


class ByteBpe:
    """Encodes text to the ids of a rank file and back. Holds a bounded memo of chunks, for words recur."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.pattern = regex.compile(pattern)
        self.byte_to_char = dict(enumerate(byte_characters()))
        self.spaced = Bounded(lambda chunk: self._encode(" " + chunk), 800_000)
        self.pretokens = Bounded(lambda pretoken: self._merge([pretoken])[0], 800_000)

    def _merge(self, pretokens: list[str]) -> list[bytes]:
        """A pre-token that is a whole token stays whole; any other is merged by sentencepiece."""
        data = [p.encode() for p in pretokens]
        out = [self.rank.get(d) for d in data]
        rest = [i for i, whole in enumerate(out) if whole is None]
        merged = self.model.encode([data[i].decode("latin-1").translate(self.byte_to_char) for i in rest], num_threads=1) if rest else []
        for i, ids in zip(rest, merged):
            out[i] = ids
        return [struct.pack(f"<{len(x)}I", *x) if isinstance(x, list) else struct.pack("<I", x) for x in out]

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.pattern.findall(text)))

    def encode_all(self, rows: list[str]) -> list[bytes]:
        """encode() of each text; pre-tokens not met before are merged together first, once each."""
        new = {chunk: self.pattern.findall(" " + chunk) for chunk in {chunk for text in rows for chunk in text.split(" ")} if chunk not in self.spaced}
        met = {p for parts in new.values() for p in parts if p not in self.pretokens}
        self.pretokens.update(zip(met, self._merge(list(met))))
        self.spaced.update((chunk, b"".join(map(self.pretokens.__getitem__, parts))) for chunk, parts in new.items())
        out = [self.encode(text) for text in rows]
        self.spaced.trim()
        self.pretokens.trim()
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        Where all white space is single spaces or line feeds between other characters, no pre-token reaches over a
        space's left edge: the chunks between spaces are encoded apart, from the memo. Any other text goes whole.
        """
        chunks = text.split(" ")
        if text and text.replace("\n", " ").split(" ") == text.split():
            return b"".join([self._encode(chunks[0]), *map(self.spaced.__getitem__, chunks[1:])])
        return self._encode(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.cache
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes each whole text and decodes it again: (doc_id, ids array<int>, decoded binary).

    Null and empty texts give no ids; a null id stays null; repeated rows stay repeated; other columns are ignored.
    One narrow pass, no shuffle; a worker holds the ids of about 4 MB of text at a time.
    """

    def run(batches):
        codec = byte_bpe(path, pattern)
        for batch in slices(batches, most=4 << 20):
            ids = codec.encode_all(texts(batch))
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
            yield record_batch({"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), values), "decoded": pa.array([codec.decode(x) for x in ids], pa.binary())})

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_arrow(picked, run, "doc_id long, ids array<int>, decoded binary")


def encoding_digests(docs: DataFrame, path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """encode_documents with digests in place of ids and bytes, made in the same task so that ids don't leave it."""

    def run(batches):
        codec = byte_bpe(path, pattern)
        for batch in slices(batches, most=4 << 20):
            ids = codec.encode_all(texts(batch))
            yield record_batch({
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
            })

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_arrow(picked, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
