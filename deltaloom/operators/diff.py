"""Comparing two snapshots, writing the changes, and applying them again.

A change is a row ``op, key, old, new, changed, row_index, new_index, hash, ts``: ``old`` and ``new`` are arrays of the
cells as text in column order, ``changed`` the positions that differ. Rows with equal keys are matched by their order
among themselves, so nothing is lost where keys repeat.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from . import staging
from .moves import moved
from ..functions.hashing import content_sha256

OPS = {"INSERT": 1, "DELETE": 2, "UPDATE": 3, "MOVE": 4}
MODES = ("content_hash", "field_by_field", "key_based", "semantic", "timestamp_based")


@dataclass
class DiffConfig:
    mode: str = "content_hash"
    keys: tuple[str, ...] = ("id",)
    timestamp: str | None = None
    order: str | None = None
    #: Positions that differ are moves: of the first of each content, or, with ``fewest_moves``, of as few rows as possible.
    detect_moves: bool = False
    fewest_moves: bool = False

    def faults(self, columns: list[str]) -> list[str]:
        out = [] if self.mode in MODES else [f"mode must be one of {', '.join(MODES)}"]
        wanted = [*(self.keys if self.mode in ("key_based", "timestamp_based") else ()), *([self.order] if self.order else []), *([self.timestamp] if self.timestamp else [])]
        out += [f"column {c} is missing" for c in wanted if c not in columns]
        if self.mode in ("field_by_field", "semantic") and not self.order:
            out.append("positions need an order column")
        if self.mode == "timestamp_based" and not self.timestamp:
            out.append("timestamp column is missing")
        return out


def cells(cols: list[str], of: str | None = None) -> Column:
    return F.array(*(F.col(f"{of}.{c}" if of else c).cast("string") for c in cols))


def changed_columns(old: Column, new: Column) -> Column:
    """Positions of cells that differ, null-safe."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(old), F.size(new)) - 1), lambda i: F.when(~F.get(old, i).eqNullSafe(F.get(new, i)), i)), lambda i: i.isNotNull())


def _record(df: DataFrame) -> DataFrame:
    op = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")
    hash_of = F.sha2(F.to_json(F.struct("old", "new"), {"ignoreNullFields": "false"}), 256)
    changed = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), changed_columns(F.col("old"), F.col("new"))).otherwise(F.array().cast("array<int>"))
    return df.select(op.alias("op"), "key", "old", "new", changed.alias("changed"), "row_index", "new_index", hash_of.alias("hash"), F.current_timestamp().alias("ts"))


def _numbered(df: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """``pos, c``: positions from 0 by the order column (then by the cells' hash) and the cells of ``cols``.

    The ranges are written once, as a range partitioning that is planned twice can cut twice in two ways; a row's place in
    its range comes from its id, and the ranges' offsets are one row a range.
    """
    ranged = df.select(F.col(order).alias("o"), cells(cols).alias("c")).withColumn("h", F.xxhash64("c")).repartitionByRange("o", "h").sortWithinPartitions("o", "h", "c")
    within = staging.staged(ranged.select(F.monotonically_increasing_id().alias("m"), "c"), "ranges")
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    counts = within.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    before = counts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # one row a range
    return within.withColumn("p", part).join(F.broadcast(before), "p").select((place + F.col("b")).alias("pos"), "c")


def by_key(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Full outer match on the key columns; of repeated keys the n-th old row meets the n-th new one.

    Keys are counted by an aggregate, and only the rows of those that repeat are numbered. Rows whose key cells are all
    null have no key: they match by their whole content, and what is left of them is deleted or inserted.
    """
    cols = old.columns
    key = F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in keys)), {"ignoreNullFields": "false"})
    has_key = F.coalesce(*(F.col(k).cast("string") for k in keys)).isNotNull()
    none = F.lit(None).cast("long")

    def side(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        rows = df.where(has_key).select(key.alias("key"), cells(cols).alias(name), *([F.col(order).alias("o")] if order else []))
        return rows, rows.groupBy("key").agg(F.count("*").alias(f"n_{name}"), F.min(name).alias(name))

    (old_rows, old_keys), (new_rows, new_keys) = side(old, "old"), side(new, "new")
    both = old_keys.join(new_keys, "key", "full_outer")
    repeats = (F.col("n_old") > 1) | (F.col("n_new") > 1)
    single = both.where(~F.coalesce(repeats, F.lit(False)) & ~F.col("old").eqNullSafe(F.col("new"))).select("key", "old", "new")
    again = both.where(repeats).select("key")

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("key").orderBy(*(["o"] if order else []), F.to_json(name)))
        return rows.join(again, "key", "left_semi").select("key", nth.alias("nth"), name)

    several = numbered(old_rows, "old").join(numbered(new_rows, "new"), ["key", "nth"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("key", "old", "new")
    keyless = by_hash(old.where(~has_key), new.where(~has_key).select(*cols)).select("key", "old", "new")
    return _record(single.unionByName(several).unionByName(keyless).select("key", "old", "new", none.alias("row_index"), none.alias("new_index")))


def by_position(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The n-th old row meets the n-th new one; what is left over at the end is inserted or deleted."""
    cols = old.columns
    a = _numbered(old, order, cols).withColumnRenamed("c", "old")
    b = _numbered(new, order, cols).withColumnRenamed("c", "new")
    both = a.join(b, "pos", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return _record(both.select(F.col("pos").cast("string").alias("key"), "old", "new", F.col("pos").alias("row_index"), F.col("pos").alias("new_index")))


def by_hash(old: DataFrame, new: DataFrame) -> DataFrame:
    """Contents that one side has more often than the other, as often as they are more: deletes or inserts. Only counts of contents are shuffled."""
    cols = old.columns
    side = lambda df, n: df.select(cells(cols).alias("c"), F.lit(n).alias("n"))
    left = side(old, 1).unionByName(side(new, -1)).groupBy("c").agg(F.sum("n").alias("n")).where("n <> 0")
    each = left.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))))
    key = content_sha256([F.get("c", F.lit(k)) for k in range(len(cols))])
    gone = F.col("n") > 0
    none = F.lit(None).cast("long")
    return _record(each.select(key.alias("key"), F.when(gone, F.col("c")).alias("old"), F.when(~gone, F.col("c")).alias("new"), none.alias("row_index"), none.alias("new_index")))


def moves(old: DataFrame, new: DataFrame, old_order: str, new_order: str) -> DataFrame:
    """Rows with the same content (without the order columns) at another position; the first of each content."""
    cols = [c for c in old.columns if c not in (old_order, new_order)]
    first = lambda df, o: _numbered(df, o, cols).groupBy(F.sha2(F.to_json("c"), 256).alias("key")).agg(F.min("pos").alias("p"), F.min_by("c", "pos").alias("c"))
    both = first(old, old_order).alias("a").join(first(new, new_order).alias("b"), "key").where("a.p <> b.p")
    none = F.array().cast("array<int>")
    return both.select(F.lit("MOVE").alias("op"), "key", F.col("a.c").alias("old"), F.col("b.c").alias("new"), none.alias("changed"), F.col("a.p").alias("row_index"), F.col("b.p").alias("new_index"), F.col("key").alias("hash"), F.current_timestamp().alias("ts"))


def fewest_moves(old: DataFrame, new: DataFrame, old_order: str, new_order: str) -> DataFrame:
    """MOVE records of as few rows as possible, repeated contents too: the n-th copy stays the n-th copy (see :mod:`moves`)."""
    cols = [c for c in old.columns if c not in (old_order, new_order)]
    side = lambda df, o: _numbered(df, o, cols).select(F.sha2(F.to_json("c"), 256).alias("key"), "pos", "c")
    a, b = (staging.staged(side(df, o), "sides") for df, o in ((old, old_order), (new, new_order)))
    found = moved(a, b)
    named = found.join(a.select(F.col("pos").alias("row_index"), F.col("c").alias("old")), "row_index")
    none = F.array().cast("array<int>")
    return named.select(F.lit("MOVE").alias("op"), "key", "old", F.col("old").alias("new"), none.alias("changed"), "row_index", "new_index", F.col("key").alias("hash"), F.current_timestamp().alias("ts"))


def _later(a: Column, b: Column, kind) -> Column:
    """Compared as what the column is; text as numbers, else as timestamps, else as text, by what both cells can be read as."""
    forms = ["decimal(38,9)"] if isinstance(kind, NumericType) else ["timestamp"] if isinstance(kind, (DateType, TimestampType, TimestampNTZType)) else ["decimal(38,9)", "timestamp"]
    return F.coalesce(*(a.try_cast(f) > b.try_cast(f) for f in forms), a > b)


def diff_files(spark: SparkSession, old: str, new: str, config: DiffConfig = DiffConfig(), options=None) -> DataFrame:
    """The changes from one CSV file to another, columns matched by their names. A file without a header line is an error."""
    from ..sources.csv_source import CsvOptions, read_csv
    from ..sources.sniff import file_size, read_header

    options = options or CsvOptions()
    for path in (old, new):
        if not file_size(spark, path) or not read_header(spark, path, options.delimiter):
            raise ValueError(f"{path} is empty")
    a, b = (read_csv(spark, path, options) for path in (old, new))
    return diff(a, b, config)


def sorted_unique(changes: DataFrame) -> DataFrame:
    """Records without repeats, by kind (inserts, deletes, updates, moves), then key."""
    rank = F.create_map(*(F.lit(x) for pair in OPS.items() for x in pair))
    return changes.dropDuplicates(["op", "key", "old", "new", "row_index", "new_index"]).orderBy(rank[F.col("op")], "key", "row_index")


def both_columns(old: DataFrame, new: DataFrame) -> list[tuple[str, str]]:
    """Name and type of the columns of both sides: the old ones, then those that only the new side has."""
    return [*old.dtypes, *((c, t) for c, t in new.dtypes if c not in old.columns)]


def aligned(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """The columns by name; those that ``df`` lacks are null."""
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns))


def diff(old: DataFrame, new: DataFrame, config: DiffConfig = DiffConfig()) -> DataFrame:
    """The changes from ``old`` to ``new``.

    Cells stand in order of :func:`both_columns`. A column that one side lacks is null there, so an added or dropped column
    is a change of each row that has something in it.
    """
    columns = both_columns(old, new)
    if faults := config.faults([c for c in old.columns if c in new.columns]):
        raise ValueError("; ".join(faults))
    old, new = aligned(old, columns), aligned(new, columns)
    if config.mode == "content_hash":
        out = by_hash(old, new)
    elif config.mode in ("field_by_field", "semantic"):
        out = by_position(old, new, config.order)
    else:
        out = by_key(old, new, list(config.keys), config.order)
        if config.mode == "timestamp_based":
            at = old.columns.index(config.timestamp)
            newer = F.col("old").isNull() | F.col("new").isNull() | _later(F.get("new", F.lit(at)), F.get("old", F.lit(at)), old.schema[config.timestamp].dataType)
            out = out.where(F.coalesce(newer, F.lit(True)))
    if config.detect_moves and config.order:
        out = out.unionByName((fewest_moves if config.fewest_moves else moves)(old, new, config.order, config.order))
    return out


def apply(base: DataFrame, changes: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """The new snapshot: old contents that were deleted or updated go, as often as they were; new contents come.

    ``like`` has the new snapshot's columns, where these aren't the old ones. The order of rows isn't kept, as tables have none.
    """
    columns = both_columns(base, like) if like is not None else base.dtypes
    cols, types = [c for c, _ in columns], dict(columns)
    base = aligned(base, columns)
    left = base.select(cells(cols).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    out = changes.where("op in ('DELETE', 'UPDATE')").groupBy(F.col("old").alias("c")).agg((-F.count("*")).alias("n"))
    come = changes.where("op in ('INSERT', 'UPDATE')").groupBy(F.col("new").alias("c")).agg(F.count("*").alias("n"))
    summed = left.unionByName(out).unionByName(come).groupBy("c").agg(F.sum("n").alias("n")).where("n > 0")
    each = summed.select("c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    out = each.select(*(F.get("c", F.lit(i)).cast(types[c]).alias(c) for i, c in enumerate(cols)))
    return out if like is None else out.select(*(f"`{c}`" for c in like.columns))


def statistics(changes: DataFrame) -> DataFrame:
    """``op, n`` of each kind of change."""
    return changes.groupBy("op").agg(F.count("*").alias("n"))


def size_ratio(new: DataFrame, changes: DataFrame) -> DataFrame:
    """Characters of the whole new snapshot over those of the changes."""
    whole = new.agg(F.coalesce(F.sum(F.length(F.concat_ws(",", *new.columns))), F.lit(0)).alias("whole"))
    part = changes.agg(F.coalesce(F.sum(F.length(F.concat_ws(",", F.coalesce("new", F.col("old"))))), F.lit(0)).alias("part"))
    return whole.crossJoin(part).withColumn("ratio", F.when(F.col("part") > 0, F.col("whole") / F.col("part")))  # two single rows


def write_delta(changes: DataFrame, path: str, columns: list[str], config: DiffConfig = DiffConfig(), codec: str = "zstd", mode: str = "errorifexists") -> None:
    """Changes as Parquet beside a header of one row."""
    header = {"version": "1", "columns": columns, "config": asdict(config)}
    changes.write.mode(mode).option("compression", codec).parquet(f"{path}/changes")
    changes.sparkSession.createDataFrame([(json.dumps(header),)], "header string").coalesce(1).write.mode(mode).json(f"{path}/header")


def read_delta(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    header = json.loads(spark.read.schema("header string").json(f"{path}/header").first()[0])
    return header, spark.read.parquet(f"{path}/changes")


def damaged(changes: DataFrame) -> DataFrame:
    """Changes whose hash doesn't fit their contents; moves carry their content's own hash and are left out."""
    again = _record(changes.where("op <> 'MOVE'").select("key", "old", "new", "row_index", "new_index", F.col("hash").alias("kept")).drop("kept"))
    return changes.where("op <> 'MOVE'").select("key", "hash").join(again.select("key", "hash"), ["key", "hash"], "left_anti")


def to_json(changes: DataFrame) -> DataFrame:
    return changes.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def from_json(lines: DataFrame) -> DataFrame:
    schema = "op string, key string, old array<string>, new array<string>, changed array<int>, row_index long, new_index long, hash string, ts timestamp"
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
