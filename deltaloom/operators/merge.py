"""Merging several sources: union, duplicates, and which row or value stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_sha256
from ..functions.similarity import mean_similarity, within_distance
from ..functions.strings import trim_space
from .clusters import clusters
from .joins import pairs_within
from .segments import LEAST, edit_candidates
from .staging import fresh, staged

STRATEGIES = ("append", "smart", "priority", "time", "schema")
DEDUPS = ("none", "exact", "key", "hash", "fuzzy", "custom")
RESOLVERS = ("first", "last", "newest", "oldest", "merge_values", "priority", "custom")
#: What the merge notes of each row: source, its priority and order, the row's order in it, and its time.
_TAGS = ("source", "priority", "ord", "row", "ts")


@dataclass
class Source:
    """A table with what the merge needs to know of it. ``row_filter`` keeps rows, ``exclude`` (column -> pattern) drops them, ``renames`` maps columns."""

    name: str
    rows: DataFrame
    priority: int = 0
    timestamp_column: str | None = None
    row_filter: Column | None = None
    exclude: dict[str, str] = field(default_factory=dict)
    renames: dict[str, str] = field(default_factory=dict)

    def prepared(self) -> DataFrame:
        df = self.rows.withColumnsRenamed(self.renames)
        if self.row_filter is not None:
            df = df.where(self.row_filter)
        for c, pattern in self.exclude.items():
            df = df.where(~F.coalesce(F.col(c).rlike(pattern), F.lit(False)))
        return df


@dataclass
class MergeConfig:
    strategy: str = "smart"
    dedup: str = "key"
    resolve: str = "newest"
    keys: tuple[str, ...] = ("id",)
    case_sensitive: bool = True
    trim: bool = True
    phonetic: bool = False
    threshold: float = 0.85
    strict_schema: bool = True
    block: tuple[str, ...] = ()
    same: Callable[[str, str], Column] | None = None
    resolver: Callable | None = None
    #: Instead of ``resolver``: takes the rows of many whole groups and the name of the column that tells them apart, and
    #: returns the rows that stay; for many small groups far cheaper than a call each.
    resolve_many: Callable | None = None

    def faults(self) -> list[str]:
        out = []
        for name, allowed in (("strategy", STRATEGIES), ("dedup", DEDUPS), ("resolve", RESOLVERS)):
            if getattr(self, name) not in allowed:
                out.append(f"{name} must be one of {', '.join(allowed)}")
        if not 0 <= self.threshold <= 1:
            out.append("threshold must be from 0 to 1")
        if self.dedup == "key" and not self.keys:
            out.append("keys are missing")
        if self.dedup == "fuzzy" and not self.block:
            out.append("fuzzy dedup needs block columns")
        if self.dedup == "custom" and self.same is None:
            out.append("custom dedup needs a condition")
        if self.resolve == "custom" and self.resolver is None and self.resolve_many is None:
            out.append("custom resolution needs a function")
        return out


def merged_columns(sources: list[Source]) -> list[str]:
    """Columns of all sources in order of first appearance."""
    return list(dict.fromkeys(c for s in sources for c in s.prepared().columns))


def schema_conflicts(sources: list[Source]) -> list[tuple[str, str, list[str]]]:
    """Columns that some source lacks or has with another type: (column, kind, sources or types)."""
    tables = {s.name: dict(s.prepared().dtypes) for s in sources}
    out = []
    for c in merged_columns(sources):
        lacking = [n for n, t in tables.items() if c not in t]
        kinds = sorted({t[c] for t in tables.values() if c in t})
        if lacking:
            out.append((c, "missing", lacking))
        if len(kinds) > 1:
            out.append((c, "types", kinds))
    return out


def append(sources: list[Source]) -> DataFrame:
    """UNION ALL by position, under the first source's names."""
    return reduce(DataFrame.union, (s.prepared() for s in sources))


def unify(sources: list[Source], strict: bool = False, tag: str = "_tag") -> DataFrame:
    """UNION ALL by name with a struct column ``tag``: source, priority, order of sources, order of rows within one read, time."""
    tables = []
    for k, s in enumerate(sources):
        df = s.prepared()
        if strict and df.columns != sources[0].prepared().columns:
            raise ValueError(f"source {s.name} has other columns than {sources[0].name}")
        ts = F.col(s.timestamp_column).try_cast("timestamp") if s.timestamp_column in df.columns else F.lit(None).cast("timestamp")
        values = (F.lit(s.name), F.lit(s.priority), F.lit(k), F.monotonically_increasing_id(), ts)
        tables.append(df.withColumn(tag, F.struct(*(v.alias(n) for n, v in zip(_TAGS, values, strict=True)))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_key(cols: list[str] | tuple[str, ...], case_sensitive: bool = True, trim: bool = True, phonetic: bool = False) -> Column:
    """Key cells (or the sound of them) as one text that keeps them apart; null where all are empty, so that such rows have no duplicates."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    cells = [trim_space(c) for c in cells] if trim else cells
    cells = cells if case_sensitive else [F.lower(c) for c in cells]
    return F.when(reduce(Column.__or__, (c != "" for c in cells)), F.to_json(F.array(*map(F.soundex, cells) if phonetic else cells)))


def keep_one(df: DataFrame, key: str, how: str, tag: str = "_tag") -> DataFrame:
    """One row of each key by order; rows without a key stay. Rows are reduced before the shuffle, so a hot key is no burden."""
    of = lambda name: F.col(f"{tag}.{name}")
    order = [of("ord").alias("ord"), of("row").alias("row")]
    rank = {
        "first": F.struct(*order), "last": F.struct(*order), "newest": F.struct(of("ts").alias("t"), *order), "oldest": F.struct(F.coalesce(of("ts"), F.lit("9999-12-31").cast("timestamp")).alias("t"), *order),
        "priority": F.struct((-of("priority")).alias("p"), *order),
    }[how]
    rest = [c for c in df.columns if c != key]
    pick = F.max_by if how in ("last", "newest") else F.min_by
    whole = fresh(df.columns, "_whole")
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct(*rest), rank).alias(whole)).select(key, f"{whole}.*")
    return one.select(*df.columns).unionByName(df.where(F.col(key).isNull()))


def merge_values(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """For each key and column the most frequent filled value, the least on ties; one shuffle by (key, column, value), one by key."""
    cell = lambda c: F.struct(F.lit(c).alias("c"), F.when(F.col(c).cast("string") != "", F.col(c).cast("string")).alias("v"))
    long = df.where(F.col(key).isNotNull()).select(key, F.explode(F.array(*map(cell, cols))).alias("x")).select(key, "x.c", "x.v")
    counted = long.groupBy(key, "c", "v").agg(F.count("*").alias("n"))
    best = counted.groupBy(key, "c").agg(F.min_by("v", F.struct(F.col("v").isNull(), (-F.col("n")).alias("n"), F.col("v"))).alias("v"))
    types = dict(df.dtypes)
    return best.groupBy(key).agg(*(F.max(F.when(F.col("c") == c, F.col("v"))).cast(types[c]).alias(c) for c in cols))


def whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """``frames`` of rows in order of ``key``, cut anew so that no group lies in two; one frame and one group are held at most."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        opens = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1][key].iloc[-1] != keys[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        if len(opens):
            yield pd.concat([*held, frame.iloc[: opens[-1]]], ignore_index=True)
            held = []
        held.append(frame.iloc[opens[-1] :] if len(opens) else frame)
    if held:
        yield pd.concat(held, ignore_index=True)


#: Different rows of a block up to which they are compared by pairs, not by an index of segments.
MOST_PAIRED = 8192


def fuzzy_clusters(df: DataFrame, id_col: str, cols: list[str], block: list[str], threshold: float = 0.85) -> DataFrame:
    """``id_col, cluster``: rows of a block whose mean field similarity reaches the threshold, and what they reach through others.

    Rows alike in every field are one before they are compared. A mean that reaches the threshold needs a field that does.
    In blocks of up to MOST_PAIRED different rows every two are told apart by a bounded edit distance, dealt to tasks by
    chunks, which costs less than an index of so few texts. In larger blocks only rows meet that share a segment of one such
    field (see :mod:`segments`). A field with few values belongs into the block: all rows alike in it are compared.
    Thresholds too low for segments compare all rows of a block.
    """
    fields = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols))
    # Rows whose block columns are all null are a block each.
    of_block = F.coalesce(F.when(reduce(Column.__or__, (F.col(b).isNotNull() for b in block)), F.to_json(F.array(*(F.col(b).cast("string") for b in block)))), F.concat(F.lit("null "), F.col(id_col).cast("string")))
    rows = df.select(F.col(id_col).alias("_id"), of_block.alias("_b"), fields.alias("_f"))
    alike = staged(rows.groupBy("_b", "_f").agg(F.min("_id").alias("_id")), "alike")
    near = mean_similarity([(F.col(f"p._f.{c}"), F.col(f"q._f.{c}")) for c in cols]) >= threshold
    least = (threshold - 0.3) / 0.7  # edit similarity of a field that reaches the threshold
    # A distance within a bound is cheap; what passes is compared in full. Fields that are both empty count as equal.
    close = reduce(Column.__or__, (within_distance(F.col(f"p._f.{c}"), F.col(f"q._f.{c}"), least) for c in cols)) if least > 0 else F.lit(True)
    blocks = alike.groupBy("_b").agg(F.count("*").alias("_n"))
    if least >= LEAST and blocks.where(F.col("_n") > MOST_PAIRED).limit(1).count():
        wide = blocks.where(F.col("_n") > MOST_PAIRED).select("_b")
        crowded = staged(alike.join(wide, "_b", "left_semi"), "crowded")
        each = [crowded.select(F.col("_id").alias("id"), F.col("_b").alias("block"), F.col(f"_f.{c}").alias("text")).where("text <> ''") for c in cols]
        found = reduce(DataFrame.union, (edit_candidates(v, least) for v in each))
        p, q = (crowded.select(F.col("_id").alias(x), F.struct(*crowded.columns).alias(y)) for x, y in (("a", "p"), ("b", "q")))
        indexed = (found.distinct() if len(each) > 1 else found).join(p, "a").join(q, "b").select("p", "q")
        pairs = pairs_within(alike.join(wide, "_b", "left_anti"), ["_b"], "_id").union(indexed)
    else:
        pairs = pairs_within(alike, ["_b"], "_id")
    found = clusters(pairs.where(close).where(near).select(F.col("p._id").alias("a"), F.col("q._id").alias("b")), "a", "b")
    named = alike.join(found, alike["_id"] == found["node"], "left").select("_b", "_f", F.coalesce("cluster", "_id").alias("cluster"))
    return rows.join(named, ["_b", "_f"]).select(F.col("_id").alias(id_col), "cluster")


def merge(sources: list[Source], config: MergeConfig = MergeConfig(), source_column: str | None = None) -> DataFrame:
    """The merged table: strategy, then duplicates, then resolution. Null and empty key cells never match."""
    if faults := config.faults():
        raise ValueError("; ".join(faults))
    if config.strategy == "append":
        return append(sources)
    how = {"priority": "priority", "time": "newest"}.get(config.strategy, config.resolve)
    lenient = config.strategy in ("schema", "time", "priority") or not config.strict_schema
    every = merged_columns(sources)
    tag, key, own_id = (fresh(every, name) for name in ("_tag", "_key", "_id"))
    rows = unify(sources, not lenient, tag)
    data = [c for c in rows.columns if c != tag]
    if config.dedup == "none":
        out = rows
    else:
        if config.dedup in ("fuzzy", "custom"):
            # Written, so that a row keeps its number however often the sources are read.
            numbered = staged(rows.withColumn(own_id, F.concat_ws(":", f"{tag}.ord", f"{tag}.row")), "numbered")
        if config.dedup == "fuzzy":
            groups = fuzzy_clusters(numbered, own_id, data, list(config.block), config.threshold).withColumnRenamed("cluster", key)
            keyed = numbered.join(groups, own_id).drop(own_id)
        elif config.dedup == "custom":
            a = numbered.select(F.col(own_id).alias("x"), F.struct(*data).alias("a"), merge_key(config.keys, config.case_sensitive, config.trim, config.phonetic).alias("block"))
            b = a.select(F.col("x").alias("y"), F.col("a").alias("b"), "block")
            links = a.join(b, "block").where("x < y").where(config.same("a", "b")).select("x", "y")
            found = clusters(links, "x", "y").toDF("node", "cluster_of")
            keyed = numbered.join(found, numbered[own_id] == found["node"], "left").select(*rows.columns, F.coalesce("cluster_of", F.col(own_id)).alias(key))
        else:
            by = {"key": merge_key([k for k in config.keys if k in data] or list(config.keys), config.case_sensitive, config.trim, config.phonetic), "hash": content_sha256(data), "exact": F.to_json(F.struct(*data), {"ignoreNullFields": "false"})}[config.dedup]
            keyed = rows.withColumn(key, by)
        if how == "merge_values":
            merged = merge_values(keyed, key, data)
            out = merged.select(*data).unionByName(keyed.where(F.col(key).isNull()).select(*data))
        elif how == "custom":
            # The function sees a group's rows with their tags in columns of their own; rows without a key have no group.
            flat = [F.col(f"{tag}.{n}").alias(fresh(every, f"_{n}")) for n in _TAGS]
            groups = keyed.where(F.col(key).isNotNull()).select(key, *data, *flat)
            schema = groups.drop(key).schema
            if config.resolve_many is not None:
                many, names = config.resolve_many, schema.names  # tasks are sent these, not the sources of the whole merge
                dealt = groups.repartition(key).sortWithinPartitions(key)
                one = dealt.mapInPandas(lambda frames: (many(rows, key)[names] for rows in whole_groups(frames, key)), schema)
            else:
                one = groups.groupBy(key).applyInPandas(lambda group: config.resolver(group.drop(columns=[key])), schema)
            packed = F.struct(*(F.col(fresh(every, f"_{n}")).alias(n) for n in _TAGS)).alias(tag)
            out = one.select(*data, packed).unionByName(keyed.where(F.col(key).isNull()).select(*data, tag))
        else:
            out = keep_one(keyed, key, how, tag)
    if source_column and tag in out.columns:
        return out.select(*data, F.col(f"{tag}.source").alias(source_column))
    return out.select(*data)


def preview(sources: list[Source], config: MergeConfig, n: int = 10) -> DataFrame:
    return merge(sources, config).limit(n)


def merge_with_callback(sources: list[Source], config: MergeConfig, on_row: Callable[[dict], bool | None], on_error: Callable[[Exception], None] | None = None) -> int:
    """Hand the merged rows to ``on_row`` one after the other, until it returns False; returns how many were handed over.

    Rows come to the driver a partition at a time, never all at once. Without ``on_error`` an error is raised, else handed over.
    """
    n = 0
    try:
        for row in merge(sources, config).toLocalIterator(prefetchPartitions=True):
            n += 1
            if on_row(row.asDict(recursive=True)) is False:
                break
    except Exception as e:
        if on_error is None:
            raise
        on_error(e)
    return n


def estimates(sources: list[Source]) -> DataFrame:
    """``source, rows, bytes`` by the optimiser's statistics, without reading a row; null where they don't say."""
    out = []
    for s in sources:
        stats = s.prepared()._jdf.queryExecution().optimizedPlan().stats()
        rows, size = stats.rowCount(), Decimal(str(stats.sizeInBytes()))
        out.append((s.name, int(str(rows.get())) if rows.isDefined() else None, size))
    return sources[0].rows.sparkSession.createDataFrame(out, "source string, rows long, bytes decimal(38,0)")


def from_file(spark: SparkSession, name: str, path: str, priority: int = 0, delimiter: str | None = None, encoding: str | None = None, **more) -> Source:
    """A source from a CSV file; what isn't given is found by looking at the file's beginning."""
    from ..sources import sniff
    from ..sources.csv_source import CsvOptions, read_csv

    options = CsvOptions(delimiter=delimiter or sniff.detect_delimiter(spark, path), encoding=encoding or sniff.detect_encoding(spark, path))
    return Source(name, read_csv(spark, path, options), priority, **more)


def merge_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows in, rows out, share removed."""
    a, b = before.agg(F.count("*").alias("rows_in")), after.agg(F.count("*").alias("rows_out"))
    return a.crossJoin(b).withColumn("removed_share", F.when(F.col("rows_in") > 0, 1 - F.col("rows_out") / F.col("rows_in")).otherwise(0.0))  # two single rows


def counted(sources: list[Source], config: MergeConfig = MergeConfig(), source_column: str | None = None) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """The merged table, and a function that says how many rows each source gave (after its filters) and how many came out.

    The rows are counted by the job that writes or reads the merged table, which the function waits for; nothing is read twice for it.
    """
    watches = [Observation() for _ in range(len(sources) + 1)]
    watched = [replace(s, rows=s.prepared().observe(w, F.count("*").alias("n")), row_filter=None, exclude={}, renames={}) for s, w in zip(sources, watches, strict=False)]
    out = merge(watched, config, source_column).observe(watches[-1], F.count("*").alias("n"))
    names = [s.name for s in sources]
    return out, lambda: dict(zip([*names, "merged"], (w.get["n"] for w in watches), strict=True))
