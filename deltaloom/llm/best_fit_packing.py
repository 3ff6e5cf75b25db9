"""Best-fit packing into bins of several permitted sizes.

Documents are cut into pieces no longer than the largest size. In order of falling length a piece goes to the open bin
that it leaves with the least space; where none fits a new bin is opened. Its size is chosen by what is still to be
packed: for each permitted size the bin is filled in thought with the longest remaining pieces that fit, then downsized,
and the size of least cost for a token so held is opened. A bin's cost has a fixed part, so that many small bins don't
pay, and a part that grows with the square of its size, as attention does. At the end every bin is downsized to the
smallest permitted size that holds its contents.

The pieces are dealt by hash into shards of bounded size and each shard is packed by itself: a shard leaves a few bins
partly full, a share of the whole that vanishes with the shard's size.
"""

from __future__ import annotations

import base64
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, staged, words_array

SIZES = (256, 512, 1024, 2048, 4096)
#: Cost of a bin of size s: s + FIXED + s * s / SQUARE.
FIXED, SQUARE = 32.0, 8192.0
#: Pieces of a shard, about.
SHARD_PIECES = 16_384
#: Text of the end mark inside a document, which the vocabulary's own library takes as one token.
SPECIALS = ("<|endoftext|>",)


def bin_cost(size: int) -> float:
    return size + FIXED + size * size / SQUARE


class Remaining:
    """How many pieces of each length are still to be packed."""

    def __init__(self, lengths: list[int]):
        self.count = Counter(lengths)
        self.bits = sum(1 << n for n in self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits ^= 1 << n

    def filled(self, free: int) -> int:
        """Tokens of the longest remaining pieces that one after the other fit into ``free``."""
        held, taken, bits = 0, 0, self.bits
        while True:
            n = (bits & ((2 << free) - 1)).bit_length() - 1
            if n <= 0:
                return held
            k = min(self.count[n], free // n)
            held, free, taken = held + k * n, free - k * n, taken + k
            bits &= (1 << n) - 1


def size_to_open(length: int, sizes: tuple[int, ...], remaining: Remaining) -> int:
    """The size that holds the piece and what may follow at the least cost a token; the smaller one on ties."""

    def cost(size: int) -> tuple[float, int]:
        held = length + remaining.filled(size - length)
        return bin_cost(next(s for s in sizes if s >= held)) / held, size

    return min((s for s in sizes if s >= length), key=cost)


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, given in order of falling length, and the final size of each bin."""
    sizes = tuple(sorted(sizes))
    space: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    has = 0  # bit s is set where a bin with s free tokens is open
    bins, offsets, used = [], [], []
    remaining = Remaining(lengths)
    for n in lengths:
        remaining.take(n)
        fit = has >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            b = space[free].pop()
            if not space[free]:
                has &= ~(1 << free)
        else:
            b, free = len(used), size_to_open(n, sizes, remaining)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if left := free - n:
            space[left].append(b)
            has |= 1 << left
    return bins, offsets, [next(s for s in sizes if s >= u) for u in used]


@lru_cache(maxsize=2)
def _coder(path: str, specials: tuple[str, ...]):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    marks = {text: len(ranks) + k for k, text in enumerate(specials)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)


def token_lengths(texts: list[str | None], vocabulary: str, specials: tuple[str, ...] = SPECIALS) -> list[int]:
    """Tokens of each text by a file of ranks; a special string inside a text is one token. A null counts as empty."""
    coder = _coder(vocabulary, specials)
    return [len(coder.encode(t, allowed_special="all")) if t else 0 for t in texts]


def pack_lengths(lengths: DataFrame, sizes: tuple[int, ...] = SIZES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack rows ``doc_id, n_tokens`` (read several times: give a table that is written).

    Returns a row for each piece: ``doc_id, piece, start`` (first token within the document), ``length, bin_id,
    bin_offset, bin_used, bin_size``. A document of no tokens gives no piece. Rows that repeat an id are separate
    documents. Null ids stay null.
    """
    most = max(sizes)
    pieces = lengths.where("n_tokens > 0").withColumn("piece", F.explode(F.expr(f"sequence(0L, cast(floor((n_tokens - 1) / {most}) as long))")))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n_tokens") - F.col("piece") * most).cast("int").alias("length"), "salt")
    count = lengths.agg(F.sum(F.ceil(F.col("n_tokens") / most))).first()[0] or 0
    shards = max(1, -(-int(count) // shard_pieces))

    def per_shard(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        bins, offsets, final = pack(rows["length"].to_pylist(), sizes)
        bins, shard = np.array(bins, np.int64), rows["shard"].to_numpy()
        used = np.bincount(bins, rows["length"].to_numpy()).astype(np.int32)
        more = {"bin_id": shard * (1 << 32) + bins, "bin_offset": np.array(offsets, np.int32), "bin_used": used[bins], "bin_size": np.array(final, np.int32)[bins]}
        rows = rows.select(["doc_id", "piece", "start", "length"])
        for name, values in more.items():
            rows = rows.append_column(name, pa.array(values))
        return rows

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(shards)))
    return sharded.groupBy("shard").applyInArrow(per_shard, "doc_id long, piece long, start long, length int, bin_id long, bin_offset int, bin_used int, bin_size int")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES, vocabulary: str | None = None) -> DataFrame:
    """Pack whole texts, measured in tokens of ``vocabulary`` (a file of ranks) plus one end mark, so a null or empty text is a piece of one token.

    Without a vocabulary they are measured in words, which are fewer than the tokens. Bytes that are no UTF-8 are
    measured as replacement characters.

    Returns what :func:`pack_lengths` returns. Repeated rows are packed as often as they occur, dealt by a hash of
    their text; further columns of ``docs`` aren't read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("salt"))
    if vocabulary is None:
        rows = rows.select("doc_id", (F.size(words_array(F.col("text"))) + 1).cast("long").alias("n_tokens"), "salt")
    else:
        read = lambda texts: [t and t.decode(errors="replace") for t in texts]
        counted = lambda r: {"doc_id": r["doc_id"], "n_tokens": [n + 1 for n in token_lengths(read(r["text"]), vocabulary)], "salt": r["salt"]}
        rows = arrow_map(rows.withColumn("text", F.col("text").cast("binary")), "doc_id long, n_tokens long, salt long", counted)
    # Rows alike in id and text would all be dealt to one shard: number them apart.
    alike = rows.groupBy("doc_id", "n_tokens", "salt").agg(F.count("*").alias("copies"))
    return pack_lengths(staged(alike.select("doc_id", "n_tokens", F.explode(F.expr("transform(sequence(1L, copies), i -> if(i = 1, salt, xxhash64(salt, i)))")).alias("salt")), "lengths"), sizes)
