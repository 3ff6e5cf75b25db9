"""SimHash near-duplicates at a given similarity of whole texts: pivot distance tables, then an exact check.

The wide form of ``simhash_dedup``: fingerprints (of 128 bits here) are made of the distinct shingles of five words,
and two texts are linked if the Jaccard similarity of their shingle sets is 0.8 or more. At that similarity
fingerprints differ in 19 of 128 bits on average, so no choice of bit runs can serve as a block. Blocks are single
shingles instead: two sets of similarity ``t`` or more share an element among the first ``n - ceil(t * n) + 1`` of
each, under any order of all elements (prefix filter). The order used here puts shingles last that are common in a
sample, then goes by hash: it decides how many pairs are looked at, never which are found.

Inside a block pairs are discarded whose sizes and positions rule the similarity out, then those whose pivot distances
or fingerprints differ by more than :func:`radius` of the smaller set, which a pair at the threshold exceeds with a
probability of LOST at most. Survivors are verified on their whole sets.

A shingle that many texts share would give all their pairs. So each text is first verified against a few leaders of the
blocks of its first shingles, where near copies nearly always meet. Blocks within one component are left out from then
on. In the rest each text is verified against the few texts whose fingerprints are nearest to its own, round by round,
as long as many pairs are left over; at last all pairs across the components found so far are formed, by pairs of
chunks of bounded size. Links inside a component don't change it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lasting, pieces, small, staged, table_chunks, utf8
from .components import components
from .simhash_dedup import distance_table, keep_found, print_of_digests, whole_tasks

SHINGLE_WORDS, SIMILARITY, SEED, BITS = 5, 0.8, 42, 128
#: Probability that a pair at the threshold is discarded by its fingerprints, and the size of sets from which on it is taken as that of this size.
LOST, EXACT_SIZE = 1e-6, 128
#: Least and most texts in the sample that orders the shingles (else an eighth), the least count in it that makes a shingle common, and how many are kept.
SAMPLE_TEXTS, COMMON, COMMON_KEPT = (4_096, 32_768), 3, 100_000
#: Shingles of a text whose blocks' leaders are tried first.
FIRST = 4
#: Partners that a text gets in a block in one round, pairs a text that may be left over for the last pass, and most rounds before it.
PARTNERS, LEFT_A_TEXT, ROUNDS = 3, 1, 8
#: A round that links fewer than one text in so many is the last.
LEAST_GAIN = 1000
#: Texts of a block that are compared with each other or with those of one other chunk, and the most pairs formed at once.
CHUNK, PAIRS_AT_ONCE = 1024, 1 << 19
#: Rows up to which a table of pairs or ids is broadcast here.
FEW_ROWS = 200_000


def differing(a: int, b: int, both: int) -> float:
    """Probability that a bit of the fingerprints of two sets (sizes ``a`` and ``b``, ``both`` in common) differs, if bits of hashes are fair coins."""

    def ones(n: int) -> np.ndarray:
        k = np.arange(n + 1)
        logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
        return np.exp(logs[n] - logs[k] - logs[n - k] - n * math.log(2))

    common = ones(both)

    def is_one(rest: int, size: int) -> np.ndarray:
        """For each number of ones in common, the probability that over half of the set's bits are ones."""
        above = np.concatenate((np.cumsum(ones(rest)[::-1])[::-1], [0.0]))  # at least k ones
        least = np.clip(size // 2 + 1 - np.arange(both + 1), 0, rest + 1)
        return above[least]

    x, y = is_one(a - both, a), is_one(b - both, b)
    return float((common * (x * (1 - y) + y * (1 - x))).sum())


@lru_cache(maxsize=8)
def radius(similarity: float) -> np.ndarray:
    """By the size of the smaller set (from EXACT_SIZE on the last): differing bits that a pair of the similarity exceeds with a probability of LOST at most.

    Bits are independent of each other; what the probability of one is follows from the sizes, the worst larger set counts.
    """
    far = []
    for n in range(EXACT_SIZE + 1):
        worst = 0.0
        for larger in range(n, math.floor(n / similarity + 1e-9) + 1) if n else ():
            both = min(n, math.ceil(similarity / (1 + similarity) * (n + larger) - 1e-9))
            worst = max(worst, *(differing(n, larger, c) for c in {both, min(n, both + 1)}))
        bits = np.arange(BITS + 1)
        logs = np.array([math.lgamma(BITS + 1) - math.lgamma(k + 1) - math.lgamma(BITS - k + 1) for k in bits])
        with np.errstate(divide="ignore", invalid="ignore"):
            chance = np.exp(logs + np.where(bits > 0, bits * np.log(worst), 0.0) + (BITS - bits) * np.log1p(-worst))
        beyond = 1 - np.cumsum(chance)
        far.append(int(np.argmax(beyond <= LOST)))
    return np.array(far, np.int64)


def text_key(text: str | bytes | None) -> int:
    """A signed 64-bit hash of the words in lower case; 0 for a text without words."""
    words = utf8(text).lower().split()
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), SEED), "big", signed=True) if words else 0


def shingles(text: str | bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text in rising order; a text of fewer words is one shingle."""
    hashed = xxhash.xxh64_intdigest
    found: list[np.ndarray] = []
    carried: list[bytes] = []
    for piece in pieces(utf8(text).lower()):
        words = carried + piece.split()
        n = len(words) - size + 1
        if n > 0:
            found.append(np.unique(np.fromiter((hashed(b" ".join(words[a : a + size]), SEED) for a in range(n)), np.uint64, n)))
        carried = words[max(0, n) :] if n > 0 else words
    if not found:
        found = [np.array([hashed(b" ".join(carried), SEED)], np.uint64)]
    return np.sort((found[0] if len(found) == 1 else np.unique(np.concatenate(found))).view(np.int64))


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def _map(df: DataFrame, schema: str, rows_of) -> DataFrame:
    """``rows_of(*columns)`` gives a list of arrays for each slice of at most 256 rows and bounded bytes."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in table_chunks(batches, 256):
            got = rows_of(*rows.values())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=names)

    return bounded_batches(df).mapInArrow(run, schema)


def common_shingles(texts: DataFrame, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (rising) and counts of the shingles most common in a sample of the column ``text``."""
    part = max(1, n_texts // min(max(SAMPLE_TEXTS[0], n_texts // 8), SAMPLE_TEXTS[1]))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)
    seen = _map(some.select("text"), "token long", lambda texts: [np.concatenate([shingles(t, size) for t in texts])])
    most = seen.groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(COMMON_KEPT).toPandas()
    order = np.argsort(most["token"].to_numpy(np.int64))
    return most["token"].to_numpy(np.int64)[order], most["count"].to_numpy(np.int64)[order]


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves: the bits that over half of the hashes have, and that over half of the mixed hashes have."""
    x = hashes.view(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return print_of_digests(hashes.byteswap().tobytes()), print_of_digests(x.byteswap().tobytes())


def prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int, similarity: float) -> DataFrame:
    """A row for each text: ``key, f0, f1`` (fingerprint), ``n`` (size of its set), ``rare`` (how many of its prefix aren't common) and ``tokens``, its prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(common)  # COMMON_KEPT entries at most

    def rows_of(texts: list[bytes | None]) -> list:
        tokens, counts = shared.value
        sizes, rare, prints, out = [], [], [], []
        for text in texts:
            own = shingles(text, size)
            prints.append(fingerprint(own))
            count = np.zeros(len(own), np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                count = np.where(tokens[at] == own, counts[at], 0)
                order = np.argsort(count, kind="stable")
                own, count = own[order], count[order]
            held = prefix_length(len(own), similarity)
            sizes.append(len(own))
            rare.append(int((count[:held] == 0).sum()))
            out.append(own[:held])
        f0, f1 = np.array(prints, np.int64).reshape(-1, 2).T
        return [np.array([text_key(t) for t in texts], np.int64), f0.copy(), f1.copy(), np.array(sizes, np.int64), np.array(rare, np.int32), pa.array(out, pa.list_(pa.int64()))]

    return _map(texts.select("text"), "key long, f0 long, f1 long, n long, rare int, tokens array<long>", rows_of)


def _few(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= FEW_ROWS else df


def verified(pairs: DataFrame, texts: DataFrame, ids: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs ``a, b`` of keys (a written table) whose whole sets have the similarity."""
    share = similarity / (1 + similarity)
    asked = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("key"))
    wanted = staged(ids.join(asked.select("key").distinct(), "key", "left_semi").select("id"), "wanted")
    some = texts.join(_few(wanted, wanted.count()), "id", "left_semi").select("text")
    sets = _map(some, "key long, own array<long>", lambda texts: [np.array([text_key(t) for t in texts], np.int64), pa.array([shingles(t, size) for t in texts], pa.list_(pa.int64()))])
    both = sets.join(_few(asked, 2 * pairs.count()), "key").groupBy("a", "b").agg(F.collect_list("own").alias("own"))
    x, y = F.col("own")[0], F.col("own")[1]
    return staged(both.where(F.size(F.array_intersect(x, y)) >= F.lit(share) * (F.size(x) + F.size(y)) - 1e-9).select("a", "b"), "links")


@lru_cache(maxsize=256)
def _within(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def pivot_table(f0: np.ndarray, f1: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each pivot, whose halves are alike; one byte each."""
    return (distance_table(f0) + distance_table(f1)).astype(np.int16)


def _nearest(x: np.ndarray, y: np.ndarray, key: np.ndarray, apart: np.ndarray, nth: int) -> np.ndarray:
    """Which of the pairs are the best of one of their rows, by distance and, from round to round more, by chance."""
    keep = np.zeros(len(x), bool)
    pair = (key[x].view(np.uint64) + key[y].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(nth * PARTNERS, (nth + 1) * PARTNERS):
        chance = (pair * np.uint64(2 * k + 0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.float64) / (1 << 24)
        rank = apart + chance * (1 + 4 * k)
        best = np.full(len(key), np.inf)
        np.minimum.at(best, x, rank)
        np.minimum.at(best, y, rank)
        keep |= (rank == best[x]) | (rank == best[y])
    return keep


def _candidates(similarity: float, nth: int | None):
    """Rows ``token, a, b, own, key, f0, f1, n, at, root`` sorted by task (token, a, b) -> pairs that are left to verify.

    With ``nth`` (a round) only the best few of each row, and rows (number of pairs left out, null).
    """
    share, far = similarity / (1 + similarity), radius(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_tasks(batches, 3):
            own, key, n, at, root = (rows[:, k].copy() for k in (3, 4, 7, 8, 9))
            f0, f1 = (rows[:, k].copy().view(np.uint64) for k in (5, 6))
            table = pivot_table(f0, f1)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            pairs: list[np.ndarray] = []
            left = 0

            def look(x: np.ndarray, y: np.ndarray) -> None:
                keep = root[x] != root[y]
                # What they share lies at or behind the first shared shingle, so the rest of the smaller side must be long enough.
                keep &= np.minimum(n[x] - at[x], n[y] - at[y]) >= share * (n[x] + n[y]) - 1e-9
                x, y = x[keep], y[keep]
                farthest = far[np.minimum(np.minimum(n[x], n[y]), EXACT_SIZE)]
                keep = np.abs(table[x] - table[y]).max(axis=1, initial=0) <= farthest
                x, y, farthest = x[keep], y[keep], farthest[keep]
                apart = np.bitwise_count(f0[x] ^ f0[y]).astype(np.int64) + np.bitwise_count(f1[x] ^ f1[y])
                keep = apart <= farthest
                found.append((x[keep], y[keep], apart[keep]))

            def settle() -> None:
                """Take over what whole tasks have found."""
                nonlocal left
                if found:
                    x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True))
                    found.clear()
                    if nth is not None and len(x):
                        keep = _nearest(x, y, key, apart, nth)
                        left += int((~keep).sum())
                        x, y = x[keep], y[keep]
                    x, y = key[x], key[y]
                    pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))

            sizes = np.diff(bounds)
            square = (rows[bounds[:-1], 1] == rows[bounds[:-1], 2]) & (sizes <= 64)
            # Small tasks of one size all at once.
            for size in np.unique(sizes[square & (sizes > 1)]).tolist():
                i, j = _within(size)
                starts = bounds[:-1][square & (sizes == size)]
                step = max(1, PAIRS_AT_ONCE // len(i))
                for k in range(0, len(starts), step):
                    first = starts[k : k + step, None]
                    look((first + i).ravel(), (first + j).ravel())
            settle()
            for a, b in zip(bounds[:-1][~square].tolist(), bounds[1:][~square].tolist(), strict=True):
                one, other = (np.flatnonzero(own[a:b] == rows[a, k]) + a for k in (1, 2))
                same = rows[a, 1] == rows[a, 2]
                step = max(1, PAIRS_AT_ONCE // max(1, len(other)))
                for k in range(0, len(one), step):
                    x, y = np.repeat(one[k : k + step], len(other)), np.tile(other, len(one[k : k + step]))
                    look(x[x < y], y[x < y]) if same else look(x, y)
                settle()
            both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])
            if nth is not None:
                yield pa.RecordBatch.from_arrays([pa.array([left], pa.int64()), pa.array([None], pa.int64())], names=["a", "b"])

    return run


def _across(blocks: DataFrame, similarity: float, nth: int | None = None) -> DataFrame:
    """Pairs ``a, b`` of keys of different roots in a block that may have the similarity; in a round, those of each chunk by itself, chunks dealt anew each time."""
    large = staged(blocks.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > CHUNK).select(F.col("token").alias("large"), F.ceil(F.col("m") / CHUNK).alias("chunks")), "large")
    n_large = large.count()
    cut = blocks.withColumns({"own": F.lit(0).cast("long"), "other": F.lit(0).cast("long")})
    if n_large:
        cut = blocks.join(_few(large, n_large), blocks["token"] == large["large"], "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("key", F.lit(nth or 0)), F.col("chunks")), F.lit(0)))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("chunks") - 1, F.lit(0)))) if nth is None else F.col("own"))
    tasks = cut.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "key", "f0", "f1", "n", F.col("at").cast("long").alias("at"), "root")
    return tasks.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b").mapInArrow(_candidates(similarity, nth), "a long, b long")


def _led(blocks: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs ``a, b``: each text and the least and greatest of the leaders of its blocks that may be like it.

    Leaders differ by block, so that a text which is unlike one of them can still meet another.
    """
    led = blocks.groupBy("token").agg(F.min_by(F.struct("key", "root", "f0", "f1", "n"), F.xxhash64("root", "key", "token")).alias("leader"))
    farthest = F.get(F.lit([int(x) for x in radius(similarity)]), F.least("n", "leader.n", F.lit(EXACT_SIZE)).cast("int"))
    apart = F.bit_count(F.col("f0").bitwiseXOR(F.col("leader.f0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("leader.f1")))
    met = blocks.join(led, "token").where((F.col("root") != F.col("leader.root")) & (apart <= farthest))
    met = met.groupBy("key").agg(F.min("leader.key").alias("low"), F.max("leader.key").alias("high")).select("key", F.explode(F.array("low", "high")).alias("other"))
    return met.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def links(texts: DataFrame, ids: DataFrame, n_texts: int, size: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``a, b`` between the keys of the distinct ``texts`` (``id, text``; ``ids``: ``key, id``): every component is joined up."""
    held = staged(prefixes(texts, common_shingles(texts, n_texts, size), size, similarity), "prefixes")
    first = held.select(F.explode(F.slice("tokens", 1, FIRST)).alias("token"), "key", "f0", "f1", "n", F.col("key").alias("root"))
    sure = verified(staged(_led(first, similarity), "pairs"), texts, ids, size, similarity)
    roots = components(sure, "a", "b")
    rooted = held.join(roots, held["key"] == roots["node"], "left").select("key", "f0", "f1", "n", "rare", "tokens", F.coalesce("root", "key").alias("root"))
    rooted = staged(rooted, "rooted")
    mixed = F.min("root") < F.max("root")
    # Blocks of common shingles are judged by an aggregate and only the others by a window; at most COMMON_KEPT shingles are common.
    often = rooted.select(F.explode(F.slice("tokens", F.col("rare") + 1, F.size("tokens"))).alias("token"), "root").groupBy("token").agg(mixed.alias("mixed")).where("mixed").select(F.col("token").alias("often"))
    each = rooted.select("key", "f0", "f1", "n", "rare", "root", F.posexplode("tokens").alias("at", "token"))
    block = Window.partitionBy("token")
    few = each.where("at < rare").withColumn("mixed", F.min("root").over(block) < F.max("root").over(block)).where("mixed").drop("mixed")
    many = each.where("at >= rare").join(F.broadcast(often), F.col("token") == F.col("often"), "left_semi")
    blocks = staged(few.unionByName(many).drop("rare"), "blocks")
    for nth in range(ROUNDS):
        asked = staged(_across(blocks, similarity, nth), "pairs")
        left = asked.where("b is null").agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
        more = verified(staged(asked.where("b is not null").distinct(), "pairs"), texts, ids, size, similarity)
        sure = sure.unionByName(more)
        roots = components(sure, "a", "b")
        again = blocks.drop("root").join(roots, blocks["key"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "key"))
        still = again.groupBy("token").agg(mixed.alias("mixed")).where("mixed").select("token")
        blocks = staged(again.join(still, "token", "left_semi"), "blocks")
        if left <= LEFT_A_TEXT * n_texts or LEAST_GAIN * more.count() < n_texts:
            break
    return sure.unionByName(verified(staged(_across(blocks, similarity).distinct(), "pairs"), texts, ids, size, similarity))


def _found(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    prints = staged(_map(rows, "doc_id long, key long", lambda ids, texts: [pa.array(ids, pa.int64()), pa.array([text_key(t) for t in texts], pa.int64())]), "prints")
    keys = staged(prints.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "keys")
    n_texts, n_rows = keys.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    # One row of each key stands for it, named by its id if ids name rows.
    if prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        ids = keys.select("key", F.col("least_id").alias("id"))
        texts = rows.withColumnRenamed("doc_id", "id")
        if n_texts < n_rows:
            others = staged(prints.join(keys.where("copies > 1"), "key").where("doc_id <> least_id").select(F.col("doc_id").alias("id")), "others")
            texts = texts.join(small(others, others.count()), "id", "left_anti")
    else:
        ids = keys.select("key", F.col("key").alias("id"))
        keyed = _map(rows.select("text"), "id long, text binary", lambda texts: [pa.array([text_key(t) for t in texts], pa.int64()), pa.array(texts, pa.binary())])
        texts = staged(keyed.dropDuplicates(["id"]), "texts")
    roots = components(links(texts, ids, n_texts, size, similarity), "a", "b")
    rooted = keys.join(roots, keys["key"] == roots["node"], "left").select("key", "least_id", F.coalesce("root", "key").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("key", "component_id")
    return prints.join(named, "key").select("doc_id", F.lower(F.lpad(F.hex("key"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; the fingerprint is the text's key in hexadecimal.

    ``component_id`` is the smallest id reachable over links of texts whose shingle sets have the similarity. Null and
    blank texts are alike. Null ids stay null and count only where a component has no other id. Further columns of
    ``docs`` aren't read. An empty table gives an empty result.
    """
    return lasting(docs.sparkSession, "components", lambda: _found(docs, id_col, text_col, size, similarity))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id. Columns stay as they are."""
    return keep_found(docs, near_duplicates(docs, id_col, text_col, size, similarity), text_key, id_col, text_col, "binary")
