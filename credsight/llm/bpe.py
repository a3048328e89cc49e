"""Byte-level BPE encoding and decoding through a sentencepiece model.

A rank file (token bytes -> rank) is turned into a sentencepiece BPE model
without any training: every byte becomes one printable stand-in character, a
token becomes the string of its bytes' stand-ins, its score is the negative
rank (so the pair of lowest rank merges first), and the normaliser is the
identity.  Texts are cut into pre-tokens by the tokenizer's pattern, each
distinct pre-token is encoded once per task (a bounded cache), and decoding
maps every id back to its bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; a
pre-token that is itself a token gets that token's id, as the rank file's own
library does; a text of any length is encoded whole; repeated rows give equal
results; an empty table gives an empty table; an id outside the vocabulary
raises ``KeyError`` when decoded.

Scale: no shuffle.  Each row is encoded where it is read.  The vocabulary (a
file of under 1 MB, the parameter ``path``) is read on the driver and goes out
once as a broadcast variable; its size does not depend on the data.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from . import common as C

CACHE_PIECES = 300_000          # pieces a worker remembers in each of two generations
CACHE_CHARS = 64                # longer pieces are encoded but not remembered
MARKS = frozenset(".,;:!?")      # a word and one of these behind it are two pre-tokens
FIRST_STAND_IN = 0x4E00         # stand-in of byte b is chr(FIRST_STAND_IN + b): letters, never white space


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def stand_ins(token: bytes) -> str:
    return "".join(chr(FIRST_STAND_IN + b) for b in token)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: piece 0 is <unk>, piece i + 1 the token of
    the i-th smallest rank, scored by its negative rank."""
    normal, unknown, bpe = 1, 2, 2
    def piece(text: str, score: float, kind: int) -> bytes:
        return _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
    out = [piece("<unk>", 0.0, unknown)]
    out += [piece(stand_ins(t), -float(r), normal) for t, r in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = (_number(3, bpe) + _number(4, len(ranks) + 1) + _number(40, 0)
               + _varint(41 << 3) + b"\xff" * 9 + b"\x01" + _varint(42 << 3) + b"\xff" * 9 + b"\x01"
               + _varint(43 << 3) + b"\xff" * 9 + b"\x01")          # no bos, eos or pad
    normalizer = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _message(2, trainer) + _message(3, normalizer)


class _Pieces(dict):
    """Ids of pieces met lately: " " + key (a piece that follows a space).  A full
    generation becomes the old one; pieces still in use come back from it."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def known(self, piece: str) -> bytes | None:
        return self.get(piece) or self.old.get(piece)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None and piece[-1:] in MARKS and piece[:-1].isalpha():
            ids = self[piece[:-1]] + self.encode(piece[-1], False)
        elif ids is None:
            ids = self.encode(piece, True)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one process, built from the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.find = regex.compile(pattern).findall
        self.loose_space = regex.compile(r" (?:\s|\Z)").search
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.id_of = [b"", *(struct.pack("<I", r) for r in sorted(ranks.values()))]
        self.ids_of = {t: struct.pack("<I", r) for t, r in ranks.items()}
        self.table = [chr(FIRST_STAND_IN + b) for b in range(256)]
        self.pieces = _Pieces(self.encode_part)

    def encode_token(self, token: str) -> bytes:
        """Ids of one pre-token: itself if it is a token, else by the model's merges."""
        raw = token.encode()
        ids = self.ids_of.get(raw) or (self.pieces.known(token[1:]) if token[0] == " " else None)
        if ids is None:
            ids = b"".join(map(self.id_of.__getitem__, self.model.encode("".join(map(self.table.__getitem__, raw)))))
        return ids

    def encode_part(self, piece: str, after_space: bool) -> bytes:
        """Ids of ``piece``, with the space before it or without.  Letters alone are one
        pre-token; anything else goes through the pattern."""
        text = " " + piece if after_space else piece
        return self.encode_token(text) if piece.isalpha() else self.encode_piece(text)

    def encode_piece(self, text: str) -> bytes:
        return b"".join(map(self.encode_token, self.find(text)))

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers.

        No pre-token of the pattern runs across the start of a space that a
        character other than white space follows, so the text can be cut there
        and the pieces be looked up.  A text with any other space is taken whole.
        """
        if self.loose_space(text):
            return self.encode_piece(text)
        first, *rest = text.split(" ")
        return self.encode_piece(first) + b"".join(map(self.pieces.__getitem__, rest))


class Decoder:
    """The inverse mapping of one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = ""):
        self.bytes_of = {r: t for t, r in ranks.items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_MADE: dict[type, tuple] = {}


def _of_worker(kind: type, shared, pattern: str):
    """The codec or decoder of this worker process, made at its first use."""
    ranks = shared.value
    key, made = _MADE.get(kind, (None, None))
    if key != (pattern, id(ranks)):
        made = kind(ranks, pattern)
        _MADE[kind] = (pattern, id(ranks)), made
    return made


def shared_ranks(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode(df: DataFrame, path: str, pattern: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (default: all) and ``token_ids`` (binary: ids as little-endian
    unsigned 32-bit integers) and ``n_tokens`` of each row's text."""
    ranks = shared_ranks(df, path)
    keep = df.columns if keep is None else keep
    fields = [StructField("token_ids", BinaryType()), StructField("n_tokens", LongType())]

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _of_worker(Codec, ranks, pattern)
        ids = [codec.encode(t) for t in C.texts_of(batch, text)]
        return [pa.array(ids, pa.large_binary()).cast(pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return C.map_rows(df, keep, fields, fn)


def decode(df: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and ``decoded`` (binary) of each row's ``token_ids``."""
    ranks = shared_ranks(df, path)
    keep = df.columns if keep is None else keep

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _of_worker(Decoder, ranks, pattern)
        ids = batch.column(batch.schema.get_field_index("token_ids")).to_pylist()
        return [pa.array([codec.decode(x or b"") for x in ids], pa.binary())]

    return C.map_rows(df, keep, [StructField("decoded", BinaryType())], fn)


def round_trip(df: DataFrame, path: str, pattern: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: adds ``token_ids``, ``n_tokens`` and ``decoded``."""
    ranks = shared_ranks(df, path)
    keep = df.columns if keep is None else keep
    fields = [StructField("token_ids", BinaryType()), StructField("n_tokens", LongType()), StructField("decoded", BinaryType())]

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        codec, decoder = _of_worker(Codec, ranks, pattern), _of_worker(Decoder, ranks, pattern)
        ids = [codec.encode(t) for t in C.texts_of(batch, text)]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([decoder.decode(x) for x in ids], pa.binary())]

    return C.map_rows(df, keep, fields, fn)


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Round trip of every document: count and digest of its ids, digest of the decoded bytes."""
    import public_tokenizers as P

    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    back = round_trip(docs, P.path(VOCABULARY), P.PATTERN, keep=["doc_id"])
    return back.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
