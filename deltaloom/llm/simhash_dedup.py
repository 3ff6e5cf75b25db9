"""SimHash near-duplicates, linked through pivot distance tables.

Each distinct fingerprint carries its Hamming distances to ``N_PIVOTS`` reference fingerprints. By the triangle
inequality two fingerprints within ``RADIUS`` bits differ by at most ``RADIUS`` in every one of these coordinates:
pairs with a larger maximum difference are discarded and only the others are verified bit by bit.

A pivot table alone would have to look at all pairs. So pairs are only formed inside blocks: the 64 bits are cut into
five runs; three differing bits leave at least two runs untouched, and each of the ten pairs of runs is a block key.
No link is lost. A block of any size is cut into chunks, and pairs of chunks are separate tasks; each yields a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, lasting, small, staged, without_ids
from .components import components

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
N_PIVOTS, PIVOT_SEED = 16, 0x9E3779B97F4A7C15
#: Fingerprints of a block that one task compares with each other or with those of one other chunk.
CHUNK = 2048
#: Bit runs as (shift, width), and the block keys made of two of them.
RUNS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BLOCKS = tuple(combinations(range(len(RUNS)), 2))


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as a signed integer; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        hashed = xxhash.xxh64_digest
        digests = b"".join([hashed(joined[a:b], SEED) for a, b in zip(start[: 1 - SHINGLE_WORDS].tolist(), end[SHINGLE_WORDS - 1 :].tolist(), strict=True)])
    return print_of_digests(digests)


def print_of_digests(digests: bytes) -> int:
    """A signed 64-bit number with the bits that are set in over half of the big-endian 64-bit digests."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; broken UTF-8 counts as U+FFFD."""
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, fp long", lambda rows: {"doc_id": rows["doc_id"], "fp": [fingerprint(t) for t in rows["text"]]})


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: multiples of an odd constant, mixed so that they lie far apart."""
    x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(PIVOT_SEED)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot, one byte each."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["block", "fp", "p0", "p1"]
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            fp = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
            table = distance_table(fp)
            packed = table.view(np.int64)
            runs = [fp >> np.uint64(s) & np.uint64((1 << w) - 1) for s, w in RUNS]
            block = np.concatenate([(runs[a] << np.uint64(13) | runs[b] | np.uint64(k << 26)).view(np.int64) for k, (a, b) in enumerate(BLOCKS)])
            again = [np.tile(x, len(BLOCKS)) for x in (fp.view(np.int64), packed[:, 0], packed[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block, *again)], names=names)


def forest(fps: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs that join what is reachable by links of at most RADIUS bits; at most one pair fewer than rows.

    A search from each row looks only at rows not reached yet, so a dense group costs far less than its pairs.
    """
    links = []
    open_rows = np.arange(len(fps))
    while open_rows.size > 1:
        queue, open_rows = [int(open_rows[0])], open_rows[1:]
        while queue and open_rows.size:
            x = queue.pop()
            apart = table[open_rows].astype(np.int16) - table[x].astype(np.int16)
            maybe = np.flatnonzero(np.abs(apart).max(axis=1) <= RADIUS)
            hit = maybe[np.bitwise_count(fps[open_rows[maybe]] ^ fps[x]) <= RADIUS]
            if hit.size:
                found = open_rows[hit].tolist()
                links += [(x, y) for y in found]
                queue += found
                open_rows = np.delete(open_rows, hit)
    return links


def whole_tasks(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of long columns sorted by the first ``n_keys`` of them -> rows of whole tasks and the bounds of the tasks; a task may run over several batches."""
    held: list[np.ndarray] = []
    task = None

    def done(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.concatenate(parts)
        cuts = np.flatnonzero((rows[1:, :n_keys] != rows[:-1, :n_keys]).any(axis=1)) + 1
        return rows, np.concatenate([[0], cuts, [len(rows)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        last = rows[-1, :n_keys].copy()
        first_of_last = int(np.argmax((rows[:, :n_keys] == last).all(axis=1)))
        if task is not None and first_of_last == 0 and (task == last).all():
            held.append(rows)
            continue
        if held or first_of_last:
            yield done([*held, rows[:first_of_last]])
        held, task = [rows[first_of_last:]], last
    if held:
        yield done(held)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task (block, a, b) -> links."""
    for rows, bounds in whole_tasks(batches, 3):
        fps = rows[:, 3].copy().view(np.uint64)
        table = np.ascontiguousarray(rows[:, 4:6]).view(np.uint8)
        # Tasks of two rows, the most common kind, all at once.
        two = bounds[:-1][np.diff(bounds) == 2]
        near = two[np.abs(table[two].astype(np.int16) - table[two + 1].astype(np.int16)).max(axis=1) <= RADIUS] if two.size else two
        near = near[np.bitwise_count(fps[near] ^ fps[near + 1]) <= RADIUS]
        out = [np.stack([fps[near], fps[near + 1]], axis=1)]
        more = np.diff(bounds) > 2
        for a, b in zip(bounds[:-1][more].tolist(), bounds[1:][more].tolist(), strict=True):
            pairs = np.array(forest(fps[a:b], table[a:b]), dtype=np.int64).reshape(-1, 2) + a
            out.append(fps[pairs])
        links = np.concatenate(out).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints in column ``fp`` (no null): every component is joined up.

    The rows of each block are counted by an aggregate; those of a block of more than CHUNK are dealt to chunks by a
    hash, so that no block is ever sorted or held as a whole, and each pair of its chunks is a task.
    """
    blocks = distinct.select("fp").mapInArrow(_blocks, "block long, fp long, p0 long, p1 long")
    large = staged(blocks.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select(F.col("block").alias("large"), F.ceil(F.col("n") / CHUNK).alias("chunks")), "large_blocks")
    dealt = blocks.join(small(large, large.count()), blocks["block"] == large["large"], "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("chunks")), F.lit(0)))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("chunks") - 1, F.lit(0)))))
    tasks = paired.select("block", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "p0", "p1")
    return tasks.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b").mapInArrow(_search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document.

    Returns ``doc_id, fingerprint, component_id``, one row for each input row. ``component_id`` is the smallest id
    reachable over links of at most three bits. A null or blank text has fingerprint zero and links like any other;
    null ids stay null and count only where a component has no other id. Repeated rows share their component.
    Further columns of ``docs`` aren't read. An empty table gives an empty result.
    """
    return lasting(docs.sparkSession, "components", lambda: _found(docs, id_col, text_col))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prints = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(distinct), "a", "b")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id. Columns stay as they are.

    Where rows share an id that stays, one row stays for each of their fingerprints.
    """
    return keep_found(docs, near_duplicates(docs, id_col, text_col), fingerprint, id_col, text_col)


def keep_found(docs: DataFrame, found: DataFrame, print_of: Callable[[str | None], int], id_col: str, text_col: str, text_type: str = "string") -> DataFrame:
    """``docs`` with one row of each component in ``found`` (``doc_id, fingerprint, component_id``), made with ``print_of``; read several times, so a written table."""
    removed = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return without_ids(docs, removed.select("doc_id"), id_col)
    # Ids that several rows share don't name a row: decide by id and fingerprint, and drop the repeats.
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay_id"), F.conv("fingerprint", 16, -10).cast("long").alias("stay_fp")).distinct()
    fp = fresh(docs, "row_fp")
    one = F.pandas_udf(lambda texts: texts.map(print_of).astype("int64"), "long")
    marked = docs.withColumn(fp, one(F.col(text_col).cast(text_type)))
    kept = marked.join(stay, marked[id_col].eqNullSafe(stay["stay_id"]) & (marked[fp] == stay["stay_fp"]), "left_semi")
    return kept.dropDuplicates([id_col, fp]).select(*docs.columns)
