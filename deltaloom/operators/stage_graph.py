"""Stage graphs: selection, closure, cycles, order, levels, critical path, plans. Graphs are tables of stages and of edges.

``stages``: id, name, priority (LOW to CRITICAL), timeout, tags (array), depends (array of ids).
Closures are joins over the table of edges, repeated until nothing is added; order and levels are worked out on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITIES = ("LOW", "NORMAL", "HIGH", "CRITICAL")
#: A stage this long, or with more dependencies, is a bottleneck.
LONG_SECONDS, MANY_DEPENDENCIES = 300, 3
CPU_FACTOR = {"LOW": 1.0, "NORMAL": 1.0, "HIGH": 1.5, "CRITICAL": 2.0}


def rank(priority: Column) -> Column:
    return reduce(lambda c, x: c.when(priority == x[1], x[0]), enumerate(PRIORITIES[1:], 1), F.when(priority == PRIORITIES[0], 0))


@dataclass
class Filter:
    """One condition; ``mode`` is include, exclude or require. ``by`` is id, name, id_regex, name_regex, tag, priority, timeout or custom."""

    by: str
    value: object = None
    exact: bool = True
    case_sensitive: bool = True
    mode: str = "include"

    def condition(self) -> Column:
        if self.by in ("id", "name"):
            c, v = F.col(self.by), str(self.value)
            c, v = (c, v) if self.case_sensitive else (F.lower(c), v.lower())
            return c == v if self.exact else c.contains(v)
        if self.by in ("id_regex", "name_regex"):
            return F.col(self.by[:-6]).rlike(("" if self.case_sensitive else "(?i)") + str(self.value))
        if self.by == "tag":
            return F.exists("tags", lambda t: t.contains(str(self.value)))
        if self.by == "priority":
            low, high = self.value
            return rank(F.col("priority")).between(PRIORITIES.index(low), PRIORITIES.index(high))
        if self.by == "timeout":
            return F.col("timeout").between(*self.value)
        if self.by == "custom":
            return self.value(F)
        raise ValueError(f"no filter by {self.by!r}")


def select(stages: DataFrame, filters: list[Filter]) -> DataFrame:
    """(Any include, or none given) and no exclude and every require."""
    of = {m: [f.condition() for f in filters if f.mode == m] for m in ("include", "exclude", "require")}
    keep = reduce(Column.__or__, of["include"]) if of["include"] else F.lit(True)
    for c in of["exclude"]:
        keep = keep & ~c
    for c in of["require"]:
        keep = keep & c
    return stages.where(keep)


def edges(stages: DataFrame) -> DataFrame:
    """``stage, needs``: a row for each dependency."""
    return stages.select(F.col("id").alias("stage"), F.explode("depends").alias("needs"))


def closure(stages: DataFrame) -> DataFrame:
    """``stage, needs`` for all direct and transitive dependencies; ends on cycles too, as pairs occur once."""
    known = edges(stages).distinct().persist()
    n = known.count()
    while True:
        longer = known.alias("a").join(known.alias("b"), F.col("a.needs") == F.col("b.stage")).select(F.col("a.stage").alias("stage"), F.col("b.needs").alias("needs"))
        following = known.union(longer).distinct().persist()
        following_n = following.count()
        known.unpersist()
        if following_n == n:
            return following
        known, n = following, following_n


def dependencies(stages: DataFrame, stage: str, transitive: bool = True) -> DataFrame:
    return (closure(stages) if transitive else edges(stages)).where(F.col("stage") == stage).select(F.col("needs").alias("id"))


def dependents(stages: DataFrame, stage: str, transitive: bool = True) -> DataFrame:
    return (closure(stages) if transitive else edges(stages)).where(F.col("needs") == stage).select(F.col("stage").alias("id"))


def on_cycles(stages: DataFrame) -> DataFrame:
    """Stages that need themselves."""
    return closure(stages).where("stage = needs").select(F.col("stage").alias("id"))


def cycles(stages: DataFrame) -> list[str]:
    """A text ``a -> b -> a`` for each group of stages on a cycle, from its least member along least neighbours."""
    looped = {r["id"] for r in on_cycles(stages).collect()}
    near = {}
    for r in edges(stages).collect():
        if r["stage"] in looped and r["needs"] in looped:
            near.setdefault(r["stage"], []).append(r["needs"])
    out, seen = [], set()
    for start in sorted(looped):
        if start in seen:
            continue
        queue, back = [start], {start: None}
        found = None
        while queue and found is None:
            x = queue.pop(0)
            for y in sorted(near.get(x, ())):
                if y == start:
                    found = x
                    break
                if y not in back:
                    back[y] = x
                    queue.append(y)
        path = [start]
        while found is not None and found != start:
            path.insert(1, found)
            found = back[found]
        seen.update(path)
        out.append(" -> ".join([*path, start]))
    return out


def _placed(needs: dict[str, list[str]]) -> dict[str, int]:
    """Level of each stage that waits for nothing outside, round by round."""
    level: dict[str, int] = {}
    while ready := [s for s, d in needs.items() if s not in level and all(x in level for x in d)]:
        level |= {s: 1 + max((level[x] for x in needs[s]), default=-1) for s in ready}
    return level


def levels(stages: DataFrame) -> DataFrame:
    """``id, level``: 0 without dependencies, else one more than the deepest of them. Stages on or behind a cycle, or with a dependency outside the table, have none.

    A graph of stages is a configuration, so it is placed on the driver.
    """
    found = _placed({r["id"]: r["depends"] or [] for r in stages.select("id", "depends").collect()})
    return stages.sparkSession.createDataFrame(sorted(found.items()), "id string, level int")


def execution_order(stages: DataFrame) -> DataFrame:
    """Level by level; within a level by priority, then the shorter timeout, then id."""
    placed = stages.join(levels(stages), "id")
    return placed.orderBy("level", rank(F.col("priority")).desc(), "timeout", "id").select("id", "level", "priority", "timeout")


def parallelism(stages: DataFrame) -> DataFrame:
    """One row: stages, levels, stages a level."""
    return levels(stages).agg(F.count("*").alias("stages"), (F.max("level") + 1).alias("levels"), (F.count("*") / (F.max("level") + 1)).alias("parallelism"))


def critical_path(stages: DataFrame) -> tuple[list[str], int]:
    """The longest chain by number of stages, then by time, then by id; and its seconds."""
    rows = {r["id"]: r for r in stages.join(levels(stages), "id").orderBy("level").collect()}
    best: dict[str, tuple[int, int, list[str]]] = {}
    for s in sorted(rows, key=lambda i: (rows[i]["level"], i)):
        before = max((best[d] for d in rows[s]["depends"] if d in best), key=lambda x: (x[0], x[1], [-ord(c) for c in x[2][-1]]), default=(0, 0, []))
        best[s] = (before[0] + 1, before[1] + rows[s]["timeout"], [*before[2], s])
    top = max(best.values(), key=lambda x: (x[0], x[1]), default=(0, 0, []))
    return top[2], top[1]


def estimates(stages: DataFrame) -> DataFrame:
    """One row: seconds one after the other, and CPU seconds by priority."""
    factor = reduce(lambda c, x: c.when(F.col("priority") == x[0], x[1]), CPU_FACTOR.items(), F.when(F.lit(False), 0.0))
    return stages.agg(F.sum("timeout").alias("sequential_seconds"), F.sum(F.col("timeout") * factor).alias("cpu_seconds"))


def bottlenecks(stages: DataFrame) -> DataFrame:
    slow, many = F.col("timeout") > LONG_SECONDS, F.size("depends") > MANY_DEPENDENCIES
    return stages.where(slow | many).select("id", slow.alias("long"), many.alias("many_dependencies"))


def efficiency(stages: DataFrame) -> DataFrame:
    """One row: stages, seconds one after the other, seconds of the critical path, and how many times faster that is."""
    path, seconds = critical_path(stages)
    total = F.coalesce(F.sum("timeout"), F.lit(0)).cast("long")
    return stages.agg(F.count("*").alias("stages"), total.alias("sequential_seconds"), F.lit(seconds).cast("long").alias("parallel_seconds"), F.lit(" -> ".join(path)).alias("critical_path")).withColumn(
        "speedup", F.when(F.col("parallel_seconds") > 0, F.col("sequential_seconds") / F.col("parallel_seconds")).otherwise(1.0)
    )


def suggestions(stages: DataFrame) -> DataFrame:
    """``id, suggestion``: shorten what is long, split what waits for many, run side by side what shares a level."""
    slow = bottlenecks(stages)
    wide = levels(stages).groupBy("level").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    return (
        slow.where("long").select("id", F.lit("takes long: divide it or shorten its timeout").alias("suggestion"))
        .unionByName(slow.where("many_dependencies").select("id", F.lit("waits for many stages: divide it").alias("suggestion")))
        .unionByName(wide.select("id", F.concat(F.lit("can run side by side with "), F.col("n") - 1, F.lit(" more of its level")).alias("suggestion")))
    )


def report(stages: DataFrame) -> DataFrame:
    """A line of JSON, in column ``value``, for each stage in order: level, limits, constraints and suggestions."""
    hints = suggestions(stages).groupBy("id").agg(F.sort_array(F.collect_list("suggestion")).alias("suggestions"))
    known = constraints(stages).groupBy("id").agg(F.sort_array(F.collect_list("constraint")).alias("constraints"))
    return execution_order(stages).join(known, "id", "left").join(hints, "id", "left").orderBy("level", rank(F.col("priority")).desc(), "timeout", "id").select(F.to_json(F.struct("*")).alias("value"))


def constraints(stages: DataFrame) -> DataFrame:
    """``id, constraint`` inferred from tags: what is active needs the network, passive may run beside anything, final runs alone."""
    rules = (("active", "network"), ("passive", "concurrent"), ("final", "exclusive"), ("testing", "rate_limited"))
    found = F.filter(F.array(*(F.when(F.array_contains("tags", t), F.lit(c)) for t, c in rules)), lambda x: x.isNotNull())
    return stages.select("id", F.explode(found).alias("constraint"))


def incompatible(stages: DataFrame) -> DataFrame:
    """Pairs of one level that can't run side by side: one of them is exclusive."""
    marked = stages.join(levels(stages), "id").join(constraints(stages).where("constraint = 'exclusive'").select("id", F.lit(True).alias("alone")), "id", "left")
    a, b = marked.select(F.col("id").alias("a"), "level", F.col("alone").alias("x")), marked.select(F.col("id").alias("b"), "level", F.col("alone").alias("y"))
    return a.join(b, "level").where("a < b and (x or y)").select("a", "b")


@dataclass
class Selection:
    status: str
    order: list[str] = field(default_factory=list)
    messages: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Selection:
        return Selection(**json.loads(text))


def plan(stages: DataFrame, filters: list[Filter], with_dependencies: bool = True) -> Selection:
    """Filter, close over dependencies, check, order. Status: ok, empty, missing, cycle."""
    chosen = select(stages, filters).select("id")
    if with_dependencies:
        chosen = chosen.union(closure(stages).join(chosen.withColumnRenamed("id", "stage"), "stage").select("needs")).distinct()
    ids = {r["id"] for r in chosen.collect()}
    if not ids:
        return Selection("empty")
    part = stages.where(F.col("id").isin(*ids)).persist()
    known = {r["id"] for r in part.select("id").collect()}
    absent = sorted((ids | {r["needs"] for r in edges(part).collect()}) - known)
    if absent:
        return Selection("missing", messages=[f"{x} is missing" for x in absent])
    if found := cycles(part):
        return Selection("cycle", messages=found)
    notes = [f"{r['a']} and {r['b']} can't run side by side" for r in incompatible(part).collect()]
    return Selection("ok", [r["id"] for r in execution_order(part).collect()], notes)


class SelectionCache:
    """Plans kept for a time; the key holds the stages' contents, the filters and whether dependencies are taken in."""

    def __init__(self, size: int = 100, ttl: float = 300.0, clock: Callable[[], float] | None = None):
        from .engine import TimedCache

        self.held, self.ttl = TimedCache(size=size, **({"clock": clock} if clock else {})), ttl
        self.hits = self.misses = 0

    def plan(self, stages: DataFrame, filters: list[Filter], with_dependencies: bool = True) -> Selection:
        version = stages.agg(F.count("*"), F.sum(F.xxhash64(*stages.columns).cast("decimal(38,0)"))).first()
        key = (tuple(version), repr(filters), with_dependencies)
        found, state = self.held.get(key)
        if state == "miss":
            self.misses += 1
            found = plan(stages, filters, with_dependencies)
            self.held.put(key, found, self.ttl)
        else:
            self.hits += 1
        return found


def run(stages: DataFrame, actions: dict[str, Callable[[], object]], mode: str = "hybrid", workers: int = 4) -> dict[str, object]:
    """Run the stages' actions: one by one, or side by side within a level; hybrid runs exclusive stages alone."""
    rows = execution_order(stages).collect()
    alone = {r["id"] for r in constraints(stages).where("constraint = 'exclusive'").collect()} if mode == "hybrid" else set()
    done: dict[str, object] = {}
    for level in sorted({r["level"] for r in rows}):
        ids = [r["id"] for r in rows if r["level"] == level]
        together = [] if mode == "sequential" else [i for i in ids if i not in alone]
        if together:
            with ThreadPoolExecutor(workers) as pool:
                done |= dict(zip(together, pool.map(lambda i: actions[i](), together), strict=True))
        for i in ids:
            if i not in done:
                done[i] = actions[i]()
    return done


def stages_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "id string, name string, priority string, timeout int, tags array<string>, depends array<string>")
