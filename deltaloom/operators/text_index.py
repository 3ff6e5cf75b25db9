"""Trigram posting lists: which rows can match a pattern, from the text that the pattern must hold."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts whose trigrams are made at once, and the trigrams of a pattern that are looked up at most.
PIECE, MOST_GRAMS = 1 << 20, 16


def postings(df: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """``gram, block, held``: the trigrams of bytes as numbers, and which of 64 rows in a row have them, as bits.

    Rows with numbers that follow one another share a line, so a frequent trigram is a line for 64 rows. A block's bits of a
    trigram may lie in several lines.
    """
    piece = PIECE

    def of_batch(rows: np.ndarray, at: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(data), piece):
            d = data[first : first + piece + 2].astype(np.int64)
            starts = np.arange(first, first + len(d) - 2)
            own = np.searchsorted(at, starts, side="right") - 1
            within = starts + 3 <= at[own + 1]
            code, row = ((d[:-2] << 16) | (d[1:-1] << 8) | d[2:])[within], rows[own[within]]
            if not len(code):
                continue
            blocks, number = np.unique(row >> 6, return_inverse=True)
            line = np.sort((number << 30) | (code << 6) | (row & 63))
            opens = np.flatnonzero(np.concatenate([[True], line[1:] >> 6 != line[:-1] >> 6]))
            held = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (line & 63).astype(np.uint64)), opens).view(np.int64)
            keys = line[opens] >> 6
            yield pa.RecordBatch.from_arrays([pa.array((keys & 0xFFFFFF).astype(np.int32)), pa.array(blocks[keys >> 24]), pa.array(held)], names=["gram", "block", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.large_binary())
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            if len(rows) and at[-1] > at[0]:
                yield from of_batch(rows, at - at[0], np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return df.select(F.col(row_col).alias("row_id"), text.alias("text")).mapInArrow(run, "gram int, block long, held long")


def literals(pattern: str) -> list[str]:
    """Runs of characters that every match of a regular expression holds; none where that isn't certain."""
    if "&&" in pattern or "\\0" in pattern or "(?" in pattern:
        return []  # read otherwise by Java, or with flags
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = re._parser.parse(pattern)
    except (re.error, RecursionError, OverflowError, Warning):
        return []
    runs: list[str] = [""]

    def walk(items) -> None:
        for op, what in items:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(what)
                continue
            runs.append("")
            if name == "SUBPATTERN":
                walk(what[-1])
                runs.append("")
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and what[0] > 0:
                walk(what[-1])
                runs.append("")

    walk(parsed)
    return [r for r in runs if r and "\ufffd" not in r]  # what a broken byte is compared as


def required(pattern: str) -> list[str]:
    """Trigrams that every match holds, at most MOST_GRAMS of them, spread over the pattern's text."""
    grams = list(dict.fromkeys(r[k : k + 3] for r in literals(pattern) for k in range(len(r) - 2)))
    step = max(1, -(-len(grams) // MOST_GRAMS))
    return grams[::step]


def rows_with(index: DataFrame, grams: list[str]) -> DataFrame:
    """``row_id`` of the rows that have all the trigrams; only their postings are read."""
    data = [g.encode("utf-8", "replace") for g in grams]
    codes = sorted({int.from_bytes(g[k : k + 3], "big") for g in data for k in range(len(g) - 2)})
    found = index.where(F.col("gram").isin(codes)).groupBy("block", "gram").agg(F.bit_or("held").alias("held"))
    blocks = found.groupBy("block").agg(F.count("*").alias("n"), F.bit_and("held").alias("held")).where((F.col("n") == len(codes)) & (F.col("held") != 0))
    bits = F.expr("filter(sequence(0, 63), k -> getbit(held, k) = 1)")
    return blocks.select("block", F.explode(bits).alias("k")).select((F.col("block") * 64 + F.col("k")).alias("row_id"))
