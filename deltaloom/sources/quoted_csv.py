"""CSV files with line breaks inside quotes, read in splits.

A split can't tell by itself whether it begins inside quotes. But a quote character opens or closes, so the parity of the
quotes before a split tells it: quotes are counted by split, and the parities add up along each file. Then each split is
read again from a known state. Whole records leave as they are; a record that runs over a border leaves in pieces, which
are put together by the split that it began in. No line is shuffled but those pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.staging import staged

#: Splits of all files, at most: one row each of their table is broadcast. Larger splits (spark.sql.files.maxPartitionBytes) go further.
MOST_SPLITS = 1_000_000
_BOM = b"\xef\xbb\xbf"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, split, line``: the physical lines in the order of each split; a carriage return stays at a line's end."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def split_states(lines: DataFrame, quote: str) -> DataFrame:
    """``file, split, inside, owner``: whether a split begins inside quotes, and the split where the record that it begins in began."""
    n_quotes = F.length("line") - F.length(F.translate("line", quote, ""))
    counted = lines.groupBy("file", "split").agg(F.sum(n_quotes).alias("n"), F.max(n_quotes % 2).alias("any_odd"))
    along = Window.partitionBy("file").orderBy("split")  # one row a split
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    state = counted.select("file", "split", (before % 2 == 1).alias("inside"), ((before + F.col("n")) % 2 == 1).alias("ends_inside"), (F.col("any_odd") > 0).alias("turns"))
    # A record that is open at a split's end began there, unless no line has ended the one that the split began in.
    began = F.when(F.col("ends_inside") & (F.col("turns") | ~F.col("inside")), F.col("split"))
    owner = F.last(began, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return state.select("file", "split", "inside", F.when(F.col("inside"), owner).alias("owner"), "ends_inside")


def _joined(lines: list[bytes], quotes: np.ndarray, inside: bool) -> tuple[list[bytes], list[bytes], bool]:
    """Whole records, the lines of one that is still open, and whether one is; ``lines`` begin outside a record or, if ``inside``, within one."""
    before = (np.cumsum(quotes) - quotes + inside) % 2
    starts = np.flatnonzero(before == 0)
    still = bool((quotes.sum() + inside) % 2)
    if not len(starts):
        return ([], lines, True) if still else ([b"\n".join(lines)], [], False)
    ends = np.append(starts[1:], len(lines))
    whole = [lines[a] if b == a + 1 else b"\n".join(lines[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    head = [b"\n".join(lines[: starts[0]])] if starts[0] else []
    return head + whole[: len(whole) - still], lines[starts[-1] :] if still else [], still


def records(lines: DataFrame, states: DataFrame, quote: str, pieces: bool) -> DataFrame:
    """``file, owner, split, first, record``: whole records, or with ``pieces`` those parts of records that run over a border."""
    quote_bytes = quote.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[bytes] = []
        inside = from_before = False  # whether a record is open, and whether it began in an earlier split
        first = True

        def out(found: list[bytes], part: bool, owner: int | None, is_first: bool) -> Iterator[pa.RecordBatch]:
            if found and part is pieces:
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[0]] * n, pa.string()), pa.array([owner] * n, pa.int64()), pa.array([at[1]] * n, pa.int64()), pa.array([is_first, *repeat(False, n - 1)], pa.bool_()), pa.array(found, pa.binary())],
                    names=["file", "owner", "split", "first", "record"],
                )

        def close() -> Iterator[pa.RecordBatch]:
            if inside and held:
                yield from out([b"\n".join(held)], True, at[2] if from_before else at[1], first and at[1] == 0)

        for batch in batches:
            keys = list(zip(batch["file"].to_pylist(), batch["split"].to_pylist(), strict=True))
            borders = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            for a, b in zip([0, *borders], [*borders, len(keys)], strict=True):
                if not keys or b == a:
                    continue
                if at is None or keys[a] != at[:2]:
                    yield from close()
                    known = batch["inside"][a].as_py()
                    if known is None:
                        raise ValueError("the files' splits changed while they were read; read them again")
                    at, held, inside, first = (*keys[a], batch["owner"][a].as_py()), [], known, True
                    from_before = inside
                column = batch["line"].slice(a, b - a)
                quotes = pc.count_substring(column, quote_bytes).to_numpy(zero_copy_only=False).astype(np.int64)
                lines = column.to_pylist()
                if at[1] == 0 and first and not held and lines[0].startswith(_BOM):
                    lines[0] = lines[0][3:]
                if inside and held:
                    # What is held has an odd number of quotes, or began before the split: it counts as one line.
                    lines, quotes = [b"\n".join(held), *lines], np.concatenate(([0 if from_before else 1], quotes))
                found, held, inside_now = _joined(lines, quotes, inside and from_before)
                if from_before and found:
                    yield from out(found[:1], True, at[2], False)
                    found, from_before, first = found[1:], False, False
                yield from out(found, False, at[1], first and at[1] == 0)
                first = first and not found
                inside = inside_now
        yield from close()

    few = F.broadcast(states.select(F.col("file").alias("of_file"), F.col("split").alias("of_split"), "inside", "owner", "ends_inside"))
    # The lines stay where they are: a broadcast join keeps their order.
    placed = lines.join(few, (F.col("file") == F.col("of_file")) & (F.col("split") == F.col("of_split")), "inner" if pieces else "left")
    if pieces:
        placed = placed.where("inside or ends_inside")
    return placed.select("file", "split", "inside", "owner", F.col("line").cast("binary").alias("line")).mapInArrow(run, "file string, owner long, split long, first boolean, record binary")


def read_records(spark: SparkSession, path: str | list[str], quote: str = '"') -> DataFrame:
    """``first, record``: every record of the files as text, line breaks inside quotes kept; ``first`` marks the first of a file.

    A quote character outside a quoted cell isn't allowed, as it would change the parity. A carriage return before the line
    break that ends a record isn't part of it. A file whose last quote is never closed ends in one long record.
    """
    lines = _lines(spark, path)
    states = staged(split_states(lines, quote), "splits")
    if (n := states.count()) > MOST_SPLITS:
        raise ValueError(f"{n} splits; raise spark.sql.files.maxPartitionBytes")
    whole = records(lines, states, quote, False).select("first", F.col("record").cast("string").alias("record"))
    over = records(lines, states, quote, True).groupBy("file", "owner").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("split", F.col("record").cast("string").alias("record")))).alias("x"))
    every = whole.unionByName(over.select("first", F.array_join("x.record", "\n").alias("record"))) if not states.where("inside or ends_inside").isEmpty() else whole
    return every.withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def parsed(record: Column, columns: list[str], options: dict[str, str]) -> Column:
    """The cells of a record as a struct of text columns."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return F.from_csv(record, schema, {k: v for k, v in options.items() if k in ("sep", "quote", "escape", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace", "mode", "maxCharsPerColumn")} | {"multiLine": "true", "lineSep": "\n"})
