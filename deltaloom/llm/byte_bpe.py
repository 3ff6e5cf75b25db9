"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

Each piece is the vocabulary entry with its bytes mapped to printable characters and the negative rank as its score,
so that the library's best-score-first merging is lowest-rank-first merging. Normalisation is the identity. Decoding
looks up the bytes of each piece.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .pretoken import ChunkCoder, byte_chars, splitter

# Field numbers and enum values of the public sentencepiece_model.proto.
MODEL_PIECES, MODEL_TRAINER, MODEL_NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TYPE_NORMAL, TYPE_UNKNOWN = 1, 2
TRAINER_MODEL_TYPE, TRAINER_VOCAB_SIZE, TRAINER_UNK_ID, TRAINER_BOS_ID, TRAINER_EOS_ID, TRAINER_PAD_ID = 3, 4, 40, 41, 42, 43
MODEL_TYPE_BPE = 2
NORMALIZER_NAME, NORMALIZER_DUMMY_PREFIX, NORMALIZER_EXTRA_SPACES, NORMALIZER_ESCAPE_SPACES = 1, 3, 4, 5


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model file: piece ids are the ranks; the unknown piece has the next free id and never occurs, as every byte is a piece."""
    chars = byte_chars()
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in ordered] != list(range(len(ordered))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0 to n - 1 and cover every byte")
    out = [_bytes(MODEL_PIECES, _bytes(PIECE_TEXT, "".join(map(chars.__getitem__, token)).encode()) + _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", -rank) + _number(PIECE_TYPE, TYPE_NORMAL)) for token, rank in ordered]
    out.append(_bytes(MODEL_PIECES, _bytes(PIECE_TEXT, b"<unk>") + _number(PIECE_TYPE, TYPE_UNKNOWN)))
    out.append(_bytes(MODEL_TRAINER, _number(TRAINER_MODEL_TYPE, MODEL_TYPE_BPE) + _number(TRAINER_VOCAB_SIZE, len(ordered) + 1) + _number(TRAINER_UNK_ID, len(ordered)) + b"".join(_number(x, -1) for x in (TRAINER_BOS_ID, TRAINER_EOS_ID, TRAINER_PAD_ID))))
    out.append(_bytes(MODEL_NORMALIZER, _bytes(NORMALIZER_NAME, b"identity") + b"".join(_number(x, 0) for x in (NORMALIZER_DUMMY_PREFIX, NORMALIZER_EXTRA_SPACES, NORMALIZER_ESCAPE_SPACES))))
    return b"".join(out)


class ByteBpe:
    """Encode and decode texts; ids are 32-bit little-endian unsigned integers in one bytes object."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.table = {b: c for b, c in enumerate(byte_chars())}
        self.piece = sorted(ranks, key=ranks.__getitem__)
        self.split = splitter(pattern)
        self.coder = ChunkCoder(self._chunks)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The model's ids of the pre-tokens of each chunk, each distinct pre-token encoded once."""
        split = [[t.encode() for t in self.split(c)] for c in chunks]
        each = list({t for c in split for t in c})
        found = self.model.encode([t.decode("latin-1").translate(self.table) for t in each], num_threads=1) if each else []
        ids = {t: struct.pack(f"<{len(x)}I", *x) for t, x in zip(each, found, strict=True)}
        return [b"".join(map(ids.__getitem__, c)) for c in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(v) for v in self.coder.values(texts)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.piece.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row for each input row. A null text counts as empty
    (0 tokens, the digests of no bytes), broken UTF-8 as U+FFFD. An empty table gives an empty result. Special strings are ordinary text. Further columns of ``docs`` aren't read.
    """

    def per_chunk(rows: dict[str, list]) -> dict[str, list]:
        bpe = load(ranks, pattern)
        ids = bpe.encode([t or "" for t in rows["text"]])
        return {"doc_id": rows["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", per_chunk)
