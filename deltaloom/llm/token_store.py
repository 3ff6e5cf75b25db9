"""Token ids in a block store with a shared zstandard dictionary.

Format, version 1. A dataset ``blocks``, one row a block, in ascending order of (part, block): ``part`` and ``block``
number it, ``before`` counts the ids before it in its part, ``dictionary`` is the SHA-256 of the shared dictionary in lowercase hex, ``payload`` holds one
independent zstandard frame a document, and the index arrays ``doc_ids, offsets, sizes, counts`` give for each
document its id, the place of its frame in the payload and its number of ids; ``first_id`` and ``last_id`` are the least and
greatest of the ids. A frame holds the ids as little-endian
unsigned 32-bit integers. Documents stand in ascending order of their id, nulls first, then of a hash of their text. The
dictionary itself is a dataset ``dictionary`` of one row. One document is read by the index arrays, a slice of the
payload and the dictionary, without its neighbours. Blocks are written and read by Spark, so any store that Spark
reaches will do and lost tasks are run again by its commit protocol.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, lasting, new_path, table_chunks
from .pretoken import ChunkCoder

END_ID = 0
BLOCK_BYTES = 1 << 20
#: The dictionary is trained on at most so many documents (those with the smallest hashes) and bytes of each; its largest size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1024, 16_384, 64 << 10
#: Pieces, spread over the whole, that are taken of a longer document.
SAMPLE_PIECES = 8
LEVEL = 3
#: Chunks that the library encodes as one text.
JOINED = 256
BLOCKS = "part int, block int, before long, dictionary string, payload binary, doc_ids array<long>, offsets array<long>, sizes array<long>, counts array<long>, first_id long, last_id long"


class LibraryIds:
    """Serialised ids of chunks by the library, many chunks to a text.

    Tokens never run over the start of a chunk, so the ids of a joined text fall to its chunks by the tokens' bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is one thread
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = np.zeros(1 + max(self.library.get_vocab(with_added_tokens=True).values()), np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            size[i] = len(token)  # one character a byte
        for i, token in self.library.get_added_tokens_decoder().items():
            size[i] = len(token.content.encode())
        self.size = size

    def __call__(self, chunks: list[str]) -> list[bytes]:
        out = [b""] * len(chunks)
        joined, alone = [], []
        for k, c in enumerate(chunks):
            (joined if c[:1] == " " and not c[1:2].isspace() and len(c) > 1 else alone).append(k)
        for k, e in zip(alone, self.library.encode_batch_fast([chunks[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, dtype="<u4").tobytes()
        groups = [joined[at : at + JOINED] for at in range(0, len(joined), JOINED)]
        for group, e in zip(groups, self.library.encode_batch_fast(["".join(map(chunks.__getitem__, g)) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.cumsum([len(chunks[k].encode()) for k in group])
            at = np.cumsum(self.size[ids])
            cuts = np.searchsorted(at, ends)
            if (at[cuts] != ends).any():
                raise ValueError("a token runs over the start of a chunk")
            data, cuts = ids.tobytes(), ((cuts + 1) * 4).tolist()
            for k, a, b in zip(group, [0, *cuts], cuts, strict=False):
                out[k] = data[a:b]
        return out


@lru_cache(maxsize=2)
def _coder(path: str) -> ChunkCoder:
    return ChunkCoder(LibraryIds(path))


def encode(path: str, texts: list[str]) -> list[bytes]:
    """The library's ids of each text and the end id, serialised."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    return [b"".join(v) + end for v in _coder(path).values(texts)]


def spread(ids: bytes) -> list[bytes]:
    """The whole array if it is short, else SAMPLE_PIECES pieces of whole ids, evenly spread over it."""
    size = SAMPLE_BYTES // SAMPLE_PIECES
    if len(ids) <= SAMPLE_BYTES:
        return [ids]
    last = (len(ids) - size) // 4
    return [ids[4 * at : 4 * at + size] for at in (k * last // (SAMPLE_PIECES - 1) for k in range(SAMPLE_PIECES))]


def train_dictionary(docs: DataFrame, vocabulary: str) -> bytes:
    """A dictionary from a bounded sample; empty where the sample is too small to train one."""

    def ids(batches):
        for rows in table_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([piece for x in encode(vocabulary, [t or "" for t in rows["text"]]) for piece in spread(x)], pa.binary())], names=["ids"])

    # Only hashes are sorted; the texts of the chosen ones are looked up afterwards.
    chosen = docs.select(F.xxhash64("doc_id", "text").alias("key")).distinct().orderBy("key").limit(SAMPLE_DOCS)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").join(F.broadcast(chosen), "key").dropDuplicates(["key"]).orderBy("key").select("text").limit(SAMPLE_DOCS)
    samples = sorted(bytes(r["ids"]) for r in texts.mapInArrow(ids, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 7 else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_store(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Encode ``doc_id, text`` (null text: empty) into a store at ``path``."""
    spark = docs.sparkSession
    trained = train_dictionary(docs, vocabulary)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(name, bytearray(trained))], "dictionary string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(trained), write_content_size=True).compress
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes, int]] = []
        size = 0

        def done() -> pa.RecordBatch:
            ids, frames, counts = zip(*held, strict=True)
            sizes = list(map(len, frames))
            known = [x for x in ids if x is not None]
            row = (part, block, before, name, b"".join(frames), list(ids), [0, *accumulate(sizes)][:-1], sizes, list(counts), min(known, default=None), max(known, default=None))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), *[pa.list_(pa.int64())] * 4, pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "before", "dictionary", "payload", "doc_ids", "offsets", "sizes", "counts", "first_id", "last_id"])

        for rows in table_chunks(batches, 256):
            for doc_id, ids in zip(rows["doc_id"], encode(vocabulary, [t or "" for t in rows["text"]]), strict=True):
                held.append((doc_id, pack(ids), len(ids) // 4))
                size += len(held[-1][1])
                if size >= BLOCK_BYTES or len(held) >= 8192:
                    yield done()
                    held, size, block, before = [], 0, block + 1, before + sum(k for _, _, k in held)
        if held:
            yield done()

    # The ranges are found from a sample of the keys, which comes to the driver: a hash stands for the text there.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    ordered = keyed.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    ordered.select("doc_id", "text").mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")


def _trained(spark, path: str) -> tuple[str, bytes]:
    name, data = spark.read.parquet(f"{path}/dictionary").first()
    trained = bytes(data)
    if hashlib.sha256(trained).hexdigest() != name:
        raise ValueError("the dictionary isn't the one that its hash names")
    return name, trained


def read_document(spark, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of one id, in the order of the store; none if there is no such id.

    The range of ids of each block is pushed down to the files; of the block that holds the id only the frame itself is
    taken out, and nothing else is decompressed.
    """
    name, trained = _trained(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    each = blocks.select("part", "block", "dictionary", "payload", F.posexplode(F.arrays_zip("doc_ids", "offsets", "sizes", "counts")).alias("at", "x")).where(F.col("x.doc_ids") == doc_id)
    frames = each.orderBy("part", "block", "at").select("dictionary", F.expr("substring(payload, int(x.offsets) + 1, int(x.sizes))").alias("frame"), F.col("x.counts").alias("n")).collect()
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(trained)).decompress
    out = []
    for r in frames:
        if r["dictionary"] != name:
            raise ValueError(f"a block was written with dictionary {r['dictionary']}")
        ids = np.frombuffer(unpack(bytes(r["frame"])), "<u4")
        if len(ids) != r["n"]:
            raise ValueError("a frame and its index disagree")
        out.append(ids)
    return out


def read_store(spark, path: str) -> DataFrame:
    """Every document of a store: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``.

    A block whose dictionary isn't the store's, or a frame whose length isn't the index's, is an error.
    """
    name, trained = _trained(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    # One number a part, that is a task of the writing job, comes to the driver.
    parts = [(r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum(total).alias("n")).orderBy("part").collect()]
    placed = spark.createDataFrame([(p, s) for (p, _), s in zip(parts, accumulate((n for _, n in parts), initial=0), strict=False)], "part int, part_start long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(trained)).decompress
        for rows in table_chunks(batches, 1):
            if rows["dictionary"] != [name]:
                raise ValueError(f"a block was written with dictionary {rows['dictionary'][0]}")
            payload, counts = memoryview(rows["payload"][0]), rows["counts"][0]
            crcs = []
            for a, n, k in zip(rows["offsets"][0], rows["sizes"][0], counts, strict=True):
                ids = unpack(payload[a : a + n])
                if len(ids) != 4 * k:
                    raise ValueError("a frame and its index disagree")
                crcs.append(zlib.crc32(ids))
            before = [rows["before"][0] + rows["part_start"][0] + x for x in [0, *accumulate(counts)][:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (rows["doc_ids"][0], before, counts, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(F.broadcast(placed), "part").select("dictionary", "payload", "doc_ids", "offsets", "sizes", "counts", "before", "part_start").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every whole text to a store in the shared folder and read it back: what :func:`read_store` returns.

    One row for each input row; a null text counts as empty and holds the end id alone. Rows that repeat an id stand
    one after the other, ordered by a hash of the text. Broken UTF-8 is encoded as U+FFFD. Null ids come first and stay null. Further columns aren't read. An empty
    table gives an empty store and an empty result. The store is deleted once the result is written.
    """
    spark = docs.sparkSession

    def through() -> DataFrame:
        path = new_path(spark, "tokens")
        write_store(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit(""))).alias("text")), vocabulary, path)
        return read_store(spark, path)

    return lasting(spark, "read_back", through)


def drop_store(spark, path: str) -> None:
    drop_staged(spark, path)
