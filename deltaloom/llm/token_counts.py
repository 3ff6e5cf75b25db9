"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one flat array of symbol ids with sequence lengths. In each round every sequence finds the
lowest rank among its adjacent pairs and merges all occurrences of that pair at once, left to right; a sequence
leaves when no pair is left. Later merges always have higher ranks than the merges that made their parts, so this
gives the library's tokens; only the surviving symbols are counted.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .pretoken import ChunkCoder, byte_chars, splitter

#: Symbols that are merged together at most; more are taken in several passes.
PASS_SYMBOLS = 2_000_000
_NONE = np.int64(1) << 40


class MergeTable:
    """The merges of a byte-level ``tokenizers`` file as sorted arrays."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} isn't a byte-level BPE vocabulary")
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in part], dtype=np.int64) for part in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.made, self.rank = key[order], made[order], order.astype(np.int64)
        self.byte_id = np.array([vocab[c] for c in byte_chars()], dtype=np.int64)
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = splitter(public_tokenizers.PATTERN)

    def count_chunks(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk; each special string inside it is one token."""
        owner: list[int] = []
        pieces: list[bytes] = []
        totals = np.zeros(len(chunks), dtype=np.int64)
        for i, chunk in enumerate(chunks):
            parts = [chunk]
            if self.special is not None and "<" in chunk:
                totals[i] = len(self.special.findall(chunk))
                parts = self.special.split(chunk)
            for part in parts:
                for token in self.split(part):
                    owner.append(i)
                    pieces.append(token.encode())
        at = 0
        while at < len(pieces):
            end, n = at, 0
            while end < len(pieces) and (end == at or n + len(pieces[end]) <= PASS_SYMBOLS):
                n += len(pieces[end])
                end += 1
            np.add.at(totals, owner[at:end], self.surviving(pieces[at:end]))
            at = end
        return totals.tolist()

    def surviving(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece (none of them empty) when no merge applies."""
        out = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        which, size = np.arange(len(pieces)), out.copy()
        while flat.size:
            start = np.cumsum(size) - size
            key = flat[:-1] << 32 | flat[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.full(flat.size, _NONE)
            rank[:-1] = np.where(self.key[at] == key, self.rank[at], _NONE)
            rank[start + size - 1] = _NONE
            best = np.minimum.reduceat(rank, start)
            done = best == _NONE
            out[which[done]] = size[done]
            hits = np.flatnonzero((rank == np.repeat(best, size)) & (rank < _NONE))
            # In a run of overlapping hits (the pair of a symbol with itself) every second one merges.
            opens = np.ones(hits.size, dtype=bool)
            opens[1:] = np.diff(hits) != 1
            nth = np.arange(hits.size)
            hits = hits[(nth - np.maximum.accumulate(np.where(opens, nth, 0))) % 2 == 0]
            flat[hits] = self.made[at[hits]]
            stay = np.repeat(~done, size)
            stay[hits + 1] = False
            size = np.add.reduceat(stay, start, dtype=np.int64)[~done]
            flat, which = flat[stay], which[~done]
        return out


@lru_cache(maxsize=2)
def _coder(path: str) -> ChunkCoder:
    return ChunkCoder(MergeTable(path).count_chunks)


def count_texts(texts: list[str | None], vocabulary: str) -> list[int]:
    """Tokens of each text; a null counts as empty."""
    return [sum(v) for v in _coder(vocabulary).values([t or "" for t in texts])]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text.

    Returns ``doc_id, n_bytes, n_tokens, over_limit``, one row for each input row (repeated ids included). A null text
    counts as empty: 0 bytes, 0 tokens. Broken UTF-8 counts as U+FFFD, in both numbers. An empty table gives an empty result. Null ids stay null; further columns of ``docs`` aren't read.
    """

    def per_chunk(rows: dict[str, list]) -> dict[str, list]:
        texts = [t or "" for t in rows["text"]]
        counts = count_texts(texts, vocabulary)
        return {"doc_id": rows["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", per_chunk)
