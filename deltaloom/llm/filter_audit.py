"""Interaction of five filters over every order of applying them, by the edges of their subset lattice.

What a filter does in an order depends only on the set of filters applied before it. There are 2^5 such sets and so 80
edges (already applied set, next filter). Each document has a mask of the filters that it fails and contributes to all
80 edges; documents are first added up by part, mask and label, so that what is spread over the edges is at most 128
rows a part. Each of the 120 orders is a path of five edges from the empty to the full set: the 600 steps are looked up
in the aggregated edges.

Only (doc_id, part, mask, digest) of a document is shuffled, never its text. Whether a document is a copy of an earlier
one is a question of its digest's smallest id; that id names the row that doesn't fail, so the digests' minima are
joined by id, not by digest, and a text with very many copies is one row a task after the map side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting, pieces, staged, table_chunks

FILTERS = "ABCDE"
#: A: fewer words fail. B: a lower percentage of distinct words fails. C: a higher percentage of capitals fails.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
#: D: any of these fails.
SYMBOLS = b"#$%&*|"

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CONTINUED = bytes(range(0x80, 0xC0))
_COPY = 1 << FILTERS.index("E")


def mask(text: bytes) -> int:
    """Bits of the filters A to D that a whole text fails; words are split at ASCII white space."""
    n_words, distinct = 0, set()
    for piece in pieces(text):
        words = piece.split()
        n_words += len(words)
        distinct.update(words)
    n_chars = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (
        n_words < LEAST_WORDS,
        100 * len(distinct) < DISTINCT_PERCENT * n_words,
        100 * capitals > CAPITAL_PERCENT * n_chars,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(1 << k for k, x in enumerate(fails) if x)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, digest`` of each row of ``doc_id, part, text``; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in table_chunks(batches):
            texts = [t or b"" for t in rows["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["part"], pa.string()), pa.array(map(mask, texts), pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
                names=["doc_id", "part", "mask", "digest"],
            )

    return docs.select("doc_id", "part", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def edges() -> list[tuple[int, int]]:
    """The 80 (set of filters applied, next filter)."""
    return [(s, f) for s in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not s >> f & 1]


def steps() -> list[tuple[str, int, int, int]]:
    """The 600 (order, step, filters applied before, filter) of all orders."""
    return [("".join(p), k + 1, sum(1 << FILTERS.index(x) for x in p[:k]), FILTERS.index(f)) for p in permutations(FILTERS) for k, f in enumerate(p)]


def _failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows counted by ``part, mask`` (all five filters), ``good, toxic``."""
    rows = staged(measured(docs), "masks")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id")).select(F.col("digest").alias("first_digest"), "first_id")
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.expr("int(coalesce(quality = 1, false))")).alias("good"), F.max(F.expr("int(coalesce(toxic = 1, false))")).alias("toxic"))
    # Rows that repeat all of it are one row here, so an id that very many rows share isn't a heavy key of the joins.
    named = rows.where("doc_id is not null").groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    named = named.join(told, F.col("doc_id") == F.col("label_id"), "left").join(first, (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
    whole = F.when(F.col("first_id").isNull(), F.col("mask").bitwiseOR(F.lit(_COPY))).otherwise(F.col("mask")).alias("mask")
    named = named.select("part", whole, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    unnamed = rows.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.lit(1).cast("long").alias("n"))
    return named.unionByName(unnamed).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edge_counts(failures: DataFrame) -> DataFrame:
    """``part, applied, filter`` and the counts of that edge; every part has all 80 edges."""
    spread = failures.withColumn("edge", F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s, f in edges())))).select("part", "mask", "good", "toxic", "n", "edge.*")
    bit = F.expr("shiftleft(1, filter)")
    fails, gone = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0).cast("long")))
    removed = fails & ~gone
    return spread.groupBy("part", "applied", "filter").agg(
        count(~fails & ~gone).alias("kept"), count(removed).alias("removed"), count(fails & gone).alias("redundant"), count(F.col("mask") == bit).alias("unique_fails"),
        count(removed & (F.col("good") == 1)).alias("good_lost"), count(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts of each filter at each step of each of the 120 orders, by part.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, filter``,
    600 rows a part, zeros included. A null part is the empty string (with that of the rows whose part is empty), a null
    text the empty text. A row without an id never counts as a copy, nor others as copies of it, and has no label; rows
    that repeat an id aren't copies of each other unless a smaller id has their text. An id counts as good or toxic if
    any of its labels says so. Broken UTF-8 is split and compared by its bytes, and its code points are the bytes that
    begin one. Further columns aren't read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(text_col).alias("text"))

    def found() -> DataFrame:
        paths = F.create_map(*(x for s in range(1 << len(FILTERS)) for x in (F.lit(s), F.lit(factorial(bin(s).count("1")) * factorial(len(FILTERS) - 1 - bin(s).count("1")) if bin(s).count("1") < len(FILTERS) else 0))))
        orders = F.element_at(paths, F.col("applied"))  # orders that go over the edge
        counted = edge_counts(_failures(rows, labels)).withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "filter")))
        walk = docs.sparkSession.createDataFrame([(o, s, a, f) for o, s, a, f in steps()], "filter_order string, step int, applied int, filter int")
        letter = F.substring(F.lit(FILTERS), F.col("filter") + 1, F.lit(1))
        return counted.join(F.broadcast(walk), ["applied", "filter"]).select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", letter.alias("filter")
        )

    return lasting(docs.sparkSession, "audit", found)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part,
    (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
    (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT AS c,
    regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS e,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM t),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (SELECT filter_order, k::INT AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS applied FROM orders, range(1, 6) g(k)),
counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (applied | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & applied = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & applied > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (mask & applied = 0 AND mask & bit > 0 AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (mask & applied = 0 AND mask & bit > 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM m, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley, substring(filter_order, step, 1) AS filter
FROM counted"""
