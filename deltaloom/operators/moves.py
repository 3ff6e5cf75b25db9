"""The fewest rows that moved: matched rows outside a longest part of both orders that is in the same order in both.

The n-th copy of a content in the old order meets the n-th in the new one. Matched rows that follow one another in both
orders are one run, so rows that stay together are one number whatever their count: an insertion at the top leaves one
run, and moves nothing. Only runs are looked at for the longest increasing part, each by its weight.

Where the runs are more than one task looks at, they are cut into strips by place and by value, and the blocks where
strips meet are tasks. A block needs no more of the others than the best totals that end in its strips before it, and
the best that ends below it in both orders; blocks that need nothing of each other are done in one round. The part found is
the same as one task over all runs would find.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import staging

#: Runs that one task looks at, and those of a strip where there are more.
RUNS_A_TASK = 1_000_000

#: What a block reads and gives, by ``kind``: its runs (``amount`` is the weight), those that its strip by value and its strip by place
#: hand on (``amount`` is the total up to there), where each run's part goes on (``amount`` is the place before it within the block or -1,
#: ``block`` and ``value`` the block and place where it leaves the block or -1), and the best run of the block.
#: ``target`` is the block that reads a row and ``due`` its round.
RUN, BY_VALUE, BY_PLACE, BACK, BEST = range(5)
_ROWS = "due int, target long, kind int, block long, place long, value long, amount long"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def ranked(df: DataFrame, by: list[str], into: str, name: str) -> DataFrame:
    """``df`` with its rank from 0 in the order of ``by``, and ``<into>_range``, the range of the order that the row lies in.

    Ranges are written once; a row's place in its range comes from its number, and the ranges' offsets are one row a range.
    """
    written = staging.staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    counts = written.groupBy(part.alias("p")).agg(F.count("*").alias("k"))
    before = counts.select("p", F.coalesce(F.sum("k").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # one row a range
    return written.withColumn("p", part).join(F.broadcast(before), "p").withColumns({into: place + F.col("b"), f"{into}_range": F.col("p")}).drop("m", "p", "b")


def nth_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (``key, pos``) with ``nth``, how many rows of its key stand before it; a key of very many rows is several ranges."""
    placed = ranked(rows, ["key", "pos"], "rank", "copies")
    first = placed.groupBy("key").agg(F.min("rank").alias("first"))
    return placed.join(first, "key").withColumn("nth", F.col("rank") - F.col("first")).drop("rank", "rank_range", "first")


def longest(runs: pd.DataFrame) -> pd.DataFrame:
    """Those of the runs (``place, value, weight``) in one heaviest part whose values rise along their places."""
    runs = runs.sort_values("place")
    values, totals, ends = [], [], []  # of parts found so far: last value, weight, last run; both rise
    back: list[int] = []
    for k, (v, w) in enumerate(zip(runs["value"].tolist(), runs["weight"].tolist(), strict=True)):
        at = bisect_left(values, v)
        total = w + (totals[at - 1] if at else 0)
        back.append(ends[at - 1] if at else -1)
        until = at
        while until < len(values) and totals[until] <= total:
            until += 1
        values[at:until], totals[at:until], ends[at:until] = [v], [total], [k]
    kept, k = [], ends[-1] if ends else -1
    while k >= 0:
        kept.append(k)
        k = back[k]
    return runs.iloc[kept[::-1]]


def _rounds(blocks: Iterable[tuple[int, int]], side: int) -> dict[tuple[int, int], int]:
    """The round of each block, from 1: after all blocks that lie before it in both orders."""
    there, found = set(blocks), {}
    above = [0] * side  # last round of the blocks in the strips up to this one, and up to each column
    for i in range(side):
        last = 0
        for j in range(side):
            last = max(last, above[j])
            if (i, j) in there:
                last = found[i, j] = last + 1
            above[j] = last
    return found


def _stairs(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows (in order of place) have a greater total than all before them, or as great a one with a lower value."""
    rank = np.empty(len(rows["place"]), np.int64)
    rank[np.lexsort((-rows["value"], rows["amount"]))] = np.arange(len(rank))
    return rank == np.maximum.accumulate(rank)


def _extended(rows: pd.DataFrame, corner: tuple[int, int, int, int] | None, right: tuple[int, int] | None, down: tuple[int, int] | None) -> Iterator[pd.DataFrame]:
    """One block: totals of its runs, and what goes on to the next block by value (``right``) and by place (``down``), each a block and its round.

    ``corner`` is the best run (total, value, place, block) below the block in both orders. Of equal totals the lower value goes on.
    """
    target, kind = int(rows["target"].iloc[0]), rows["kind"].to_numpy()
    names = ("block", "place", "value", "amount")
    part = lambda k, by: {c: x[c].to_numpy() for x in [rows.loc[kind == k, list(names)].sort_values(by)] for c in names}
    runs, column, row = part(RUN, "place"), part(BY_VALUE, "value"), part(BY_PLACE, "place")
    n, n_column, n_row = (len(x["place"]) for x in (runs, column, row))
    values, totals, ends = column["value"].tolist(), column["amount"].tolist(), list(range(n, n + n_column))
    best, below, end = (corner[0], corner[1], n + n_column + n_row) if corner else (0, 0, -1)
    total_of, back, leaves = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    arrived = np.searchsorted(row["place"], runs["place"]).tolist()  # rows of the strip by place that stand before each run
    seen = 0
    for k, (v, w) in enumerate(zip(runs["value"].tolist(), runs["amount"].tolist(), strict=True)):
        for seen in range(seen, arrived[k]):
            t, u = int(row["amount"][seen]), int(row["value"][seen])
            if t > best or (t == best and u < below):
                best, below, end = t, u, n + n_column + seen
        seen = arrived[k]
        at = bisect_left(values, v)
        total, before = (w + totals[at - 1], ends[at - 1]) if at and totals[at - 1] > best else (w + best, end)
        total_of[k], back[k] = total, before
        leaves[k] = leaves[before] if 0 <= before < n else before
        until = at
        while until < len(values) and totals[until] <= total:
            until += 1
        values[at:until], totals[at:until], ends[at:until] = [v], [total], [k]
    runs["amount"] = total_of
    every = {c: np.concatenate((runs[c], column[c], row[c], [corner[at] if corner else 0, -1])) for c, at in (("block", 3), ("place", 2))}  # the last is for none
    frame = lambda due, to, k, x: pd.DataFrame({"due": due, "target": to, "kind": k, **x}).astype({"due": "int32", "target": "int64", "kind": "int32"})
    yield frame(0, target, BACK, {"block": every["block"][leaves], "place": runs["place"], "value": every["place"][leaves], "amount": np.where((back >= 0) & (back < n), every["place"][back], -1)})
    top = np.lexsort((-runs["value"], total_of))[-1:]
    yield frame(-1, target, BEST, {c: runs[c][top] for c in names})
    if down:
        ends = np.array(ends, np.int64)
        origin = {c: np.concatenate((runs[c], column[c])) for c in ("block", "place")}
        yield frame(down[1], down[0], BY_VALUE, {"block": origin["block"][ends], "place": origin["place"][ends], "value": np.array(values, np.int64), "amount": np.array(totals, np.int64)})
    if right:
        both = {c: np.concatenate((runs[c], row[c])) for c in names}
        order = np.argsort(both["place"])
        both = {c: x[order] for c, x in both.items()}
        stay = _stairs(both)
        yield frame(right[1], right[0], BY_PLACE, {c: x[stay] for c, x in both.items()})


def _task(corners: dict, right: dict, down: dict):
    """:func:`_extended` for the blocks of one round."""

    def extend(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["target"].iloc[0])
        return pd.concat(_extended(rows, corners.get(block), right.get(block), down.get(block)), ignore_index=True)[_NAMES]

    return extend


def _walked(rows: pd.DataFrame, last: dict[int, int]) -> pd.DataFrame:
    """The places of one block that lie on the part, from the last of them back."""
    rows = rows.sort_values("place")
    place, before = rows["place"].to_numpy(), rows["amount"].to_numpy()
    back, on = np.where(before < 0, -1, np.searchsorted(place, before)).tolist(), []
    k = int(np.searchsorted(place, last[int(rows["target"].iloc[0])]))
    while k >= 0:
        on.append(k)
        k = back[k]
    return pd.DataFrame({"place": place[on]})


def _handed_on(numbers: dict[int, int], side: int) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[int, int]]]:
    """For each block the next one of its strip by place and of its strip by value, with their rounds."""
    lines = (sorted(numbers), sorted(numbers, key=lambda b: (b % side, b)))
    same = (lambda a, b: a // side == b // side, lambda a, b: a % side == b % side)
    return tuple({a: (b, numbers[b]) for a, b in zip(line[:-1], line[1:], strict=True) if alike(a, b)} for line, alike in zip(lines, same, strict=True))


def longest_in_blocks(runs: DataFrame, n: int) -> DataFrame:
    """``place`` of the runs that :func:`longest` would keep of all ``n`` runs, by blocks. Of each block with runs a few numbers come to the driver."""
    spark, side = runs.sparkSession, -(-n // RUNS_A_TASK)
    for by, strip in (("value", "j"), ("place", "i")):
        runs = ranked(runs, [by], "nth", f"by-{by}").withColumn(strip, F.floor(F.col("nth") / RUNS_A_TASK)).drop("nth", "nth_range")
    target = (F.col("i") * side + F.col("j")).alias("target")
    runs = staging.staged(runs.select(target, F.lit(RUN).alias("kind"), F.expr(f"i * {side} + j").alias("block"), "place", "value", F.col("weight").alias("amount")), "blocks")
    found = _rounds((divmod(r["target"], side) for r in runs.select("target").distinct().collect()), side)
    numbers = {i * side + j: r for (i, j), r in found.items()}
    right, down = _handed_on(numbers, side)
    sources: dict[int, set[int]] = {}
    for after in (right, down):
        for block, (_, due) in after.items():
            sources.setdefault(due, set()).add(numbers[block])
    by_round = spark.createDataFrame([(r, b) for b, r in numbers.items()], "due int, target long")
    dealt = f"{staging.shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    runs.join(F.broadcast(by_round), "target").repartition("target").select(*_NAMES).write.partitionBy("due").parquet(dealt)  # a row a block is broadcast
    given = f"{staging.shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    schema = StructType([f for f in StructType.fromDDL(_ROWS) if f.name != "due"])

    def read(*paths: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*paths)

    best, value_of, of = np.zeros((side, side), np.int64), np.zeros((side, side), np.int64), {}
    for r in range(1, max(numbers.values()) + 1):
        blocks = [b for b, k in numbers.items() if k == r]
        corners = {}
        for b in blocks:
            i, j = divmod(b, side)
            if i and j and (most := best[:i, :j].max()):
                corners[b] = of[tuple(min(np.argwhere(best[:i, :j] == most).tolist(), key=lambda at: value_of[tuple(at)]))]
        task = _task(corners, {b: right[b] for b in blocks if b in right}, {b: down[b] for b in blocks if b in down})
        rows = read(f"{dealt}/due={r}", *(f"{given}/round={q}/due={r}" for q in sorted(sources.get(r, ()))))
        rows.repartition(2 * len(blocks), "target").groupBy("target").applyInPandas(task, _ROWS).write.partitionBy("due").parquet(f"{given}/round={r}")
        for x in read(f"{given}/round={r}/due=-1").collect():
            at = divmod(x["target"], side)
            best[at], value_of[at], of[at] = x["amount"], x["value"], (x["amount"], x["value"], x["place"], x["block"])
    # Back from the best of all, block by block; then each block on the way is walked in its own task.
    _, _, place, block = max(of.values(), key=lambda x: (x[0], -x[1]))
    last: dict[int, int] = {}
    while block >= 0:
        last[block] = place
        x = read(f"{given}/round={numbers[block]}/due=0").where((F.col("target") == block) & (F.col("place") == place)).first()
        block, place = x["block"], x["value"]
    visited = read(*(f"{given}/round={r}/due=0" for r in sorted({numbers[b] for b in last}))).where(F.col("target").isin(list(last)))
    return visited.select("target", "place", "amount").repartition(2 * len(last), "target").groupBy("target").applyInPandas(lambda x: _walked(x, last), "place long")


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """``key, row_index, new_index`` of the rows that moved, from ``key, pos`` of both sides. Rows that only one side has don't count as moves.

    As few rows as possible, whatever the number of runs; which ones of equally few is fixed by the data. Null keys match nothing. An empty side gives an empty result.
    """
    a, b = (nth_copies(x.where("key is not null").select("key", "pos")) for x in (old, new))
    both = a.select("key", "nth", F.col("pos").alias("row_index")).join(b.select("key", "nth", F.col("pos").alias("new_index")), ["key", "nth"]).drop("nth")
    rows = ranked(ranked(both, ["new_index"], "value", "by-new").drop("value_range"), ["row_index"], "place", "by-old")
    along = Window.partitionBy("place_range").orderBy("place")  # a range of the order
    opens = F.coalesce((F.col("value") != F.lag("value").over(along) + 1).cast("int"), F.lit(1))
    rows = staging.staged(rows.withColumn("opens", opens).withColumn("run", F.sum("opens").over(along)).select("key", "row_index", "new_index", "place", "value", "place_range", "run"), "runs")
    runs = staging.staged(rows.groupBy("place_range", "run").agg(F.min("place").alias("place"), F.min("value").alias("value"), F.count("*").alias("weight")), "weighed")
    n = runs.count()
    if n <= RUNS_A_TASK:
        schema = runs.schema
        kept = runs.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda x: longest(x)[schema.names], schema)
    else:
        kept = runs.join(longest_in_blocks(runs, n), "place", "left_semi")
    kept = staging.staged(kept, "kept")
    return rows.join(kept.select("place_range", "run"), ["place_range", "run"], "left_anti").select("key", "row_index", "new_index")
