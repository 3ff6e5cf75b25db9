"""The SQL surface: tables by name, a small dialect on top of Spark SQL, cached results, result export, statistics."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import staging, text_index
from ..functions.strings import tokens
from ..sources.csv_source import CsvOptions, read_csv, text_schema
from ..sources.sniff import file_size

#: Groups whose states a task holds before it hands them on.
HELD_GROUPS = 100_000
#: About what a bucket of an index holds.
BUCKET_BYTES = 16 << 20

_TOKEN = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`\\]|\\.)*`|[A-Za-z_][A-Za-z0-9_]*|\s+|.)""", re.S)


def tokenise(sql: str) -> list[str]:
    """Strings, quoted identifiers, words, white space and single characters."""
    return _TOKEN.findall(sql)


def _argument(parts: list[str], at: int) -> tuple[int, int] | None:
    """Bounds inside the bracket that follows ``at``."""
    k = at + 1
    while k < len(parts) and parts[k].isspace():
        k += 1
    if k >= len(parts) or parts[k] != "(":
        return None
    depth = 0
    for end in range(k, len(parts)):
        depth += {"(": 1, ")": -1}.get(parts[end], 0)
        if not depth:
            return k + 1, end
    return None


def rewrite(sql: str, compat: bool = False) -> str:
    """The dialect as Spark SQL: DISTINCT(c) as an aggregate, GROUP_CONCAT, REGEX, double-quoted identifiers, a trailing semicolon.

    In compat LIMIT 0 is no limit, COUNT(c) counts rows, and c NOT IN (...) holds for a null. Strings and quoted
    identifiers are never looked into.
    """
    parts = tokenise(sql.strip().rstrip(";"))
    out: list[str] = []
    k, before = 0, ""
    while k < len(parts):
        p, word = parts[k], parts[k].upper()
        if word == "DISTINCT" and before not in ("SELECT", "(", "ALL") and (span := _argument(parts, k)):
            inside = rewrite("".join(parts[span[0] : span[1]]), compat)
            out.append(f"count(DISTINCT {inside})")
            k, before = span[1] + 1, ")"
            continue
        if word == "GROUP_CONCAT" and (span := _argument(parts, k)):
            inside = rewrite("".join(parts[span[0] : span[1]]), compat)
            out.append(f"listagg({inside}, ',') WITHIN GROUP (ORDER BY {re.sub(r'^(?i:distinct) ', '', inside)})")
            k, before = span[1] + 1, ")"
            continue
        if compat and word == "COUNT" and (span := _argument(parts, k)) and re.fullmatch(r"\s*[A-Za-z_`\"][^()\s]*\s*", "".join(parts[span[0] : span[1]])):
            out.append("count(*)")
            k, before = span[1] + 1, ")"
            continue
        if compat and word == "IN" and before == "NOT" and (span := _argument(parts, k)) and (start := _operand(out)) is not None:
            inside = rewrite("".join(parts[span[0] : span[1]]), compat)
            name = "".join(out[start:]).strip()[: -len("NOT")].strip()
            out[start:] = [f"coalesce({name} NOT IN ({inside}), true)"]
            k, before = span[1] + 1, ")"
            continue
        if word == "REGEX" and before not in ("", ".", "SELECT", ",", "(", "AS", "BY"):
            p = "RLIKE"
        elif p[0] in "\"`" and len(p) > 1:
            p = "`" + re.sub(r"\\(.)", r"\1", p[1:-1]).replace("`", "``") + "`"
        if compat and word == "LIMIT":
            rest = "".join(parts[k + 1 :]).lstrip()
            if re.match(r"0+\b(?!\.)", rest):
                k += 1 + next(i for i, x in enumerate(parts[k + 1 :]) if x == "0") + 1
                continue
        out.append(p)
        if not p.isspace():
            before = word
        k += 1
    return "".join(out)


def _operand(out: list[str]) -> int | None:
    """Where the (qualified) name before a final NOT begins."""
    k = len(out) - 1
    while k >= 0 and (out[k].isspace() or out[k].upper() == "NOT"):
        k -= 1
    if k < 0 or not re.fullmatch(r"[A-Za-z_]\w*|`.*`", out[k], re.S):
        return None
    while k >= 2 and out[k - 1] == ".":
        k -= 2
    return k


_CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "ON")


def without_column(sql: str, name: str) -> str:
    """Spark SQL without an unknown column: an empty text where it is selected or sorted by; a condition that asks for it holds."""
    parts = [x for x in tokenise(sql)]
    wanted = lambda x: x.lower() == name.lower() or (x.startswith("`") and x[1:-1].lower() == name.lower())
    solid = [k for k, x in enumerate(parts) if not x.isspace()]
    clause, depth, clause_depth = "", 0, 0
    for at, k in enumerate(solid):
        x = parts[k]
        depth += {"(": 1, ")": -1}.get(x, 0)
        if x.upper() in _CLAUSES and not (at and parts[solid[at - 1]] == "."):
            clause, clause_depth = x.upper(), depth
        if not wanted(x) or (at + 1 < len(solid) and parts[solid[at + 1]] in (".", "(")):
            continue
        first = at
        while first >= 2 and parts[solid[first - 1]] == ".":
            first -= 2
        if clause in ("WHERE", "HAVING", "ON"):
            low = first
            while low and parts[solid[low - 1]].upper() not in ("AND", "OR", "NOT", "(", *_CLAUSES):
                low -= 1
            high, inner, between = at + 1, 0, False
            while high < len(solid):
                y = parts[solid[high]].upper()
                inner += {"(": 1, ")": -1}.get(y, 0)
                if inner < 0 or (inner == 0 and (y in ("OR", *_CLAUSES) or (y == "AND" and not between))):
                    break
                between = y == "BETWEEN" or (between and y != "AND")
                high += 1
            # What is skipped holds under NOT too: the NOT goes with it, and so do brackets around nothing else.
            while True:
                word = parts[solid[low - 1]].upper() if low else ""
                if word == "NOT":
                    low -= 1
                elif word == "(" and high < len(solid) and parts[solid[high]] == ")" and low > 1 and parts[solid[low - 2]].upper() in ("NOT", "AND", "OR", "(", *_CLAUSES):
                    low, high = low - 1, high + 1
                else:
                    break
            return "".join(parts[: solid[low]]) + "TRUE " + "".join(parts[solid[high] :] if high < len(solid) else [])
        bare = clause == "SELECT" and depth == clause_depth and parts[solid[first - 1]].upper() in ("SELECT", ",", "DISTINCT") and (at + 1 == len(solid) or parts[solid[at + 1]].upper() in (",", "FROM"))
        return "".join(parts[: solid[first]]) + ("''" + (f" AS `{name}`" if bare else "")) + "".join(parts[k + 1 :])
    return sql


def names_in(spark: SparkSession, sql: str) -> list[str]:
    """Tables that a statement of the dialect reads."""
    return relations(spark, rewrite(sql))


def relations(spark: SparkSession, text: str) -> list[str]:
    """Tables that a statement reads, by Spark's own parser."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    return sorted(set(re.findall(r"'UnresolvedRelation \[([^\]]+)\]", plan)))


class TooManyRows(ValueError):
    """A result has more rows than the engine's configuration permits."""


@dataclass
class Result:
    """A query's table and ways to take it out. Text forms bring the result to the driver: they're for results, not tables.

    ``timed`` runs what brings rows to the driver, within the engine's time limit.
    """

    df: DataFrame
    seconds: float = 0.0
    cached: bool = False
    timed: Callable[[Callable], object] = lambda run: run()

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.timed(self.df.collect)]

    def row(self, k: int) -> tuple:
        """The k-th row; of a result without an order, in that of its partitions, which is stable once the result is cached."""
        got = self.timed(self.df.offset(k).limit(1).collect) if k >= 0 else []
        if not got:
            raise IndexError(k)
        return tuple(got[0])

    def column(self, name: str) -> list:
        if name not in self.columns:
            raise KeyError(name)
        return [r[0] for r in self.timed(self.df.select(F.col(f"`{name}`")).collect)]

    def cell(self, k: int, name: str):
        if name not in self.columns:
            raise KeyError(name)
        return self.row(k)[self.columns.index(name)]

    def sort(self, *by: str, ascending: bool | list[bool] = True) -> Result:
        return Result(self.df.orderBy(*by, ascending=ascending), timed=self.timed)

    def slice(self, start: int, n: int) -> Result:
        return Result(self.df.offset(max(0, start)).limit(max(0, n)), timed=self.timed)

    def to_csv(self) -> str:
        quote = lambda v: '"' + ("" if v is None else str(v)).replace('"', '""') + '"'
        return "\n".join(",".join(map(quote, r)) for r in [self.columns, *self.rows()]) + "\n"

    def to_json(self) -> str:
        data = [json.loads(x) for x in self.df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
        return json.dumps({"data": data, "count": len(data)}, ensure_ascii=False)

    def to_table(self, width: int = 50) -> str:
        rows = self.rows()
        if not rows:
            return "Empty result set"
        cut = lambda v: t if len(t := "NULL" if v is None else str(v)) <= width else t[: width - 3] + "..."
        body = [[cut(v) for v in r] for r in [self.columns, *rows]]
        wide = [max(len(r[i]) for r in body) for i in range(len(self.columns))]
        rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
        line = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, wide, strict=True)) + "|"
        return "\n".join([rule, line(body[0]), rule, *map(line, body[1:]), rule, f"{len(rows)} rows"])

    def save_csv(self, path: str) -> None:
        self.df.write.mode("overwrite").options(header="true", quoteAll="true", escape='"').csv(path)


@dataclass
class EngineConfig:
    cache_results: bool = True
    cache_size: int = 100
    #: More rows than this are an error; None plans no limit at all.
    max_rows: int | None = None
    #: Larger results aren't kept in the cache.
    max_bytes: int = 500 << 20
    timeout_seconds: float = 300.0
    compat: bool = False
    auto_index: bool = False


@dataclass
class Index:
    """A written copy of a table. ``hash`` and ``composite``: bucketed by the columns; ``btree``: ranges in order, so files and row groups are left out by their statistics; ``bloom``: row groups are left out by their filters; ``fulltext``, ``trigram``: tokens or trigrams to rows."""

    table: str
    columns: tuple[str, ...]
    kind: str
    data: DataFrame
    version: int
    places: list[str]
    name: str | None = None


@dataclass
class Statistics:
    executed: int = 0
    hits: int = 0
    misses: int = 0
    seconds: float = 0.0
    failed: int = 0


class Engine:
    """Tables and queries of one session. Table names are the engine's own: their views have a prefix that no other engine has."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config, self.statistics = spark, config or EngineConfig(), Statistics()
        self.prefix = f"engine_{uuid.uuid4().hex}_"
        self.versions: dict[str, int] = {}
        self.cache: OrderedDict[tuple, DataFrame] = OrderedDict()
        self.indexes: dict[tuple[str, tuple[str, ...], str], Index] = {}

    # Tables

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(f"`{self.prefix}{name}`")
        self.versions[name] = self.versions.get(name, 0) + 1
        self._forget(name)
        if self.config.auto_index and df.columns:
            self.create_index(name, (df.columns[0],), "hash")

    def load(self, name: str, path: str, options: CsvOptions = CsvOptions(multi_line=True)) -> None:
        self.register(name, read_csv(self.spark, path, options))

    def register_rows(self, name: str, columns: list[str], rows: list[list[str]]) -> None:
        self.register(name, self.spark.createDataFrame([(list(r) + [""] * len(columns))[: len(columns)] for r in rows], text_schema(columns)))

    def tables(self) -> list[str]:
        return sorted(self.versions)

    def table(self, name: str) -> DataFrame:
        """A table of the engine, else of the session."""
        return self.spark.table(f"`{self.prefix}{name}`" if name in self.versions else name)

    def _own(self, text: str) -> str:
        """The statement with the engine's tables as its first common tables, under their own names."""
        try:
            read = {n.lower() for n in relations(self.spark, text)}
        except ParseException:
            return text  # what is wrong with it is said when it is run
        own = [n for n in self.versions if n.lower() in read]
        if not own:
            return text
        first = ", ".join(f"`{n}` AS (SELECT * FROM `{self.prefix}{n}`)" for n in own)
        # Common tables of the statement's own may hide those of the engine.
        return f"WITH {first} SELECT * FROM ({text})" if re.match(r"\s*WITH\b", text, re.IGNORECASE) else f"WITH {first} {text}"

    def unload(self, name: str) -> bool:
        if name not in self.versions:
            return False
        self.spark.catalog.dropTempView(f"{self.prefix}{name}")
        del self.versions[name]
        self._forget(name)
        for key in [k for k in self.indexes if k[0] == name]:
            self.drop_index(*key)
        return True

    def _forget(self, name: str) -> None:
        """Results that read an older version of the table go."""
        for key in [k for k in self.cache if any(n == name for n, _ in k[1])]:
            self.cache.pop(key).unpersist()

    # Queries

    def plan(self, sql: str) -> DataFrame:
        """The statement's table; in compat, unknown columns are taken out one after the other."""
        text, seen = rewrite(sql, self.config.compat), set()
        while True:
            try:
                return self.spark.sql(self._own(text))
            except AnalysisException as e:
                name = ((e.getMessageParameters() or {}).get("objectName") or "").split("`.`")[-1].strip("`")
                if not self.config.compat or not (e.getCondition() or "").startswith("UNRESOLVED_COLUMN") or (text, name) in seen:
                    raise
                seen.add((text, name))
                text = without_column(text, name)

    def execute(self, sql: str) -> Result:
        """A statement's result, with an error after the timeout or beyond ``max_rows``. Equal text over equal table versions is a cache hit.

        Nothing is computed before rows are asked for, unless a bound on rows is set together with the cache: then as many
        rows as permitted are counted at once. A result is kept by what it computes when it is first read. Statements
        over tables that aren't the engine's are never kept, as it doesn't know when these change.
        """
        began = time.monotonic()
        try:
            names = names_in(self.spark, sql)
            known = {n.lower(): n for n in self.versions}
            key = (sql, tuple((known.get(n.lower(), n), self.versions.get(known.get(n.lower(), n), 0)) for n in names))
            keeps = self.config.cache_results and all(n.lower() in known for n in names)
            if keeps and key in self.cache:
                self.cache.move_to_end(key)
                self.statistics.hits += 1
                self.statistics.executed += 1
                return Result(self.cache[key], time.monotonic() - began, True, self._timed)
            df, most = self.plan(sql), self.config.max_rows
            # One row more than permitted tells that there are too many; a limit is only planned where one is set.
            df = df if most is None else df.limit(most + 1)
            if keeps and most is not None:
                df = df.persist()
                try:
                    n = self._timed(df.count)
                    if n > most:
                        raise TooManyRows(f"the result has more than {most} rows")
                except Exception:
                    df.unpersist()
                    raise
            elif most is not None:
                df = df.observe(watch := Observation(), F.count("*").alias("n"))
            if keeps:
                self._keep(key, df)
        except Exception:
            self.statistics.failed += 1
            raise
        self.statistics.misses += 1
        self.statistics.executed += 1
        self.statistics.seconds += time.monotonic() - began
        if keeps or most is None:
            return Result(df, time.monotonic() - began, False, self._timed)

        def within(run: Callable) -> object:
            got = self._timed(run)
            if watch.get["n"] > most:
                raise TooManyRows(f"the result has more than {most} rows")
            return got

        return Result(df, time.monotonic() - began, False, within)

    def _keep(self, key: tuple, df: DataFrame) -> None:
        """Into the cache unless its plan says that it may be too large for it; it is computed again then whenever it is read."""
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size > self.config.max_bytes:
            df.unpersist()
            return
        self.cache[key] = df.persist()
        while len(self.cache) > self.config.cache_size:
            self.cache.popitem(last=False)[1].unpersist()

    def _timed(self, run: Callable) -> object:
        """``run()``; its jobs are cancelled at the timeout."""
        tag = f"query-{uuid.uuid4().hex}"

        def tagged() -> object:
            self.spark.addTag(tag)
            try:
                return run()
            finally:
                self.spark.removeTag(tag)

        with ThreadPoolExecutor(1) as pool:
            job = pool.submit(tagged)
            try:
                return job.result(self.config.timeout_seconds)
            except FutureTimeout:
                self.spark.interruptTag(tag)
                raise TimeoutError(f"the query took more than {self.config.timeout_seconds:g} s") from None

    def register_function(self, name: str, function: Callable, returns: str = "string", vectorised: bool = True) -> None:
        """A function that statements can call: of Arrow batches (pandas Series to Series), or of single rows."""
        self.spark.udf.register(name, F.pandas_udf(function, returns) if vectorised else F.udf(function, returns))

    def register_aggregate(self, name: str, function: Callable, returns: str = "double") -> None:
        """An aggregate that statements can call with GROUP BY: of the Arrow arrays of a group to one value.

        A group is handed over whole, so it is for groups of bounded size; :func:`grouped` is for others.
        """
        self.spark.udf.register(name, F.arrow_udf(function, returns, F.ArrowUDFType.GROUPED_AGG))

    def register_table_function(self, name: str, handler: type, returns: str) -> None:
        """A table function that statements can call, also LATERAL: a class whose ``eval`` yields rows."""
        self.spark.udtf.register(name, F.udtf(handler, returnType=returns))

    def explain(self, sql: str, mode: str = "formatted") -> str:
        return self.spark._jvm.PythonSQLUtils.explainString(self.plan(sql)._jdf.queryExecution(), mode)

    def clear_cache(self) -> None:
        while self.cache:
            self.cache.popitem()[1].unpersist()

    # Indexes

    def create_index(self, table: str, columns: tuple[str, ...], kind: str = "hash", options: dict[str, str] | None = None) -> Index:
        """A written copy of the table laid out for lookups; ``options`` are those of the Parquet writer.

        ``fulltext`` and ``trigram`` are posting lists of one column's tokens or trigrams beside a copy with row numbers.
        ``bloom`` leaves the rows as they lie and writes a Bloom filter of each column into every row group.
        """
        df, columns, name, options = self.table(table), tuple(columns), None, options or {}
        path = f"{staging.shared_dir(self.spark)}/index-{uuid.uuid4().hex}"
        places = [path]
        if kind in ("hash", "composite"):
            size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            # Tables of unknown size are given the most that the optimiser can name.
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions")) if size >= 1 << 62 else max(8, min(4096, size // BUCKET_BYTES))
            name = f"index_{uuid.uuid4().hex}"
            df.repartition(n, *columns).write.option("path", path).bucketBy(n, *columns).sortBy(*columns).saveAsTable(name)
            data = self.spark.table(name)
        elif kind == "btree":
            df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.parquet(path)
            data = self.spark.read.schema(df.schema).parquet(path)
        elif kind == "bloom":
            filters = {f"parquet.bloom.filter.{k}#{c}": "true" for c in columns for k in ("enabled", "adaptive.enabled")}
            df.write.options(**filters, **options).parquet(path)
            data = self.spark.read.schema(df.schema).parquet(path)
        elif kind in ("fulltext", "trigram"):
            row = staging.fresh(df.columns, "row_id")
            df.withColumn(row, F.monotonically_increasing_id()).write.options(**options).parquet(f"{path}/rows")
            copy = self.spark.read.parquet(f"{path}/rows")
            if kind == "fulltext":
                # A frequent token is many rows; the row number parts it into ranges.
                lists = inverted_index(copy, row, columns[0]).repartitionByRange("token", "row_id").sortWithinPartitions("token", "row_id")
            else:
                # A frequent trigram is a line for 64 rows. Dealt by a hash, as ranges would make all lines twice; blocks part a trigram.
                lists = text_index.postings(copy, row, columns[0]).repartition("gram", F.shiftright("block", 16)).sortWithinPartitions("gram", "block")
            lists.write.parquet(f"{path}/tokens")
            data = self.spark.read.parquet(f"{path}/tokens")
        else:
            raise ValueError(f"no index kind {kind!r}")
        self.drop_index(table, columns, kind)
        self.indexes[table, columns, kind] = index = Index(table, columns, kind, data, self.versions.get(table, 0), places, name)
        return index

    def drop_index(self, table: str, columns: tuple[str, ...], kind: str) -> bool:
        index = self.indexes.pop((table, tuple(columns), kind), None)
        if index is None:
            return False
        if index.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {index.name}")
        for path in index.places:
            staging.drop(self.spark, path)
        return True

    def rebuild_index(self, table: str, columns: tuple[str, ...], kind: str) -> Index:
        self.drop_index(table, columns, kind)
        return self.create_index(table, columns, kind)

    def optimise_indexes(self) -> int:
        """Write the indexes of tables that have changed since anew; how many they were."""
        stale = [k for k, i in self.indexes.items() if i.version != self.versions.get(k[0], 0)]
        for key in stale:
            self.rebuild_index(*key)
        return len(stale)

    def list_indexes(self) -> list[tuple[str, tuple[str, ...], str]]:
        return sorted(self.indexes)

    def index_bytes(self) -> dict[tuple[str, tuple[str, ...], str], int]:
        """What each index takes on disk."""
        return {key: sum(file_size(self.spark, p) for p in index.places) for key, index in self.indexes.items()}

    def _rows_for(self, table: str, columns: list[str], equal: bool) -> DataFrame:
        """The copy that serves best, else the table; stale copies aren't used. A bucketed copy needs all its columns by value, a sorted one its first."""
        for kinds in (("hash", "composite"), ("btree",), ("bloom",)) if equal else (("btree",),):
            for (t, cols, kind), index in self.indexes.items():
                if t == table and kind in kinds and index.version == self.versions.get(table, 0) and (set(cols) <= {*columns} if index.name else {*cols} & {*columns} if kind == "bloom" else cols[0] in columns):
                    return index.data
        return self.table(table)

    def lookup(self, table: str, column: str | tuple[str, ...], value) -> DataFrame:
        """Rows where the column has the value, or all columns have theirs."""
        columns, values = ([column], [value]) if isinstance(column, str) else (list(column), list(value))
        return self._rows_for(table, columns, True).where(reduce(Column.__and__, (F.col(c) == v for c, v in zip(columns, values, strict=True))))

    def lookup_range(self, table: str, column: str, low, high) -> DataFrame:
        return self._rows_for(table, [column], False).where(F.col(column).between(low, high))

    def lookup_pattern(self, table: str, column: str, pattern: str) -> DataFrame:
        """Rows whose text matches.

        What stands before the first special character of an anchored pattern is a range of the sorted copy. Of other
        patterns the trigrams that every match holds are looked up where the column has a ``trigram`` index; what has them all is compared.
        """
        index = self.indexes.get((table, (column,), "trigram"))
        if index and index.version == self.versions.get(table, 0) and (grams := text_index.required(pattern)):
            return self._rows_of(index, text_index.rows_with(index.data, grams)).where(F.col(column).rlike(pattern))
        df, fixed = self._rows_for(table, [column], False), re.match(r"\^([A-Za-z0-9 _-]+)(?![*?{|])", pattern)
        if fixed and "|" not in pattern:
            df = df.where(F.col(column).startswith(fixed[1]))
        return df.where(F.col(column).rlike(pattern))

    def lookup_token(self, table: str, column: str, token: str) -> DataFrame:
        """Rows whose text has the token, each as often as it is in the table."""
        index = self.indexes.get((table, (column,), "fulltext"))
        if index is None or index.version != self.versions.get(table, 0):
            index = self.create_index(table, (column,), "fulltext")
        return self._rows_of(index, index.data.where(F.col("token") == token.lower()).select("row_id"))

    def _rows_of(self, index: Index, found: DataFrame) -> DataFrame:
        """The rows of an index's copy by their numbers, in column ``row_id``."""
        columns = self.table(index.table).columns
        row = staging.fresh(columns, "row_id")
        return self.spark.read.parquet(f"{index.places[0]}/rows").join(found.withColumnRenamed("row_id", row), row, "left_semi").select(*columns)


def grouped(df: DataFrame, keys: list[str], partial: Callable, merge: Callable, state: str) -> DataFrame:
    """``keys`` and the columns of DDL ``state``: an aggregate in mergeable states, for groups of any size.

    ``partial`` takes the rows of a group in one batch as a pandas table and returns a state as a tuple, ``merge`` makes one
    state of two. A task keeps a state for each of its groups, so what is shuffled is a state a group and task.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [state])
    names = [*keys, *(c.split()[0] for c in state.split(", "))]

    def table(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*(None if pd.isna(k) else k for k in key), *s) for key, s in held.items()], columns=names)

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        for rows in batches:
            for key, group in rows.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = merge(held[key], partial(group)) if key in held else partial(group)
            if len(held) > HELD_GROUPS:
                yield table(held)
                held = {}
        if held:
            yield table(held)

    def of_group(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
        return table({key: reduce(merge, states[names[len(keys) :]].itertuples(index=False, name=None))})

    return df.mapInPandas(of_task, schema).groupBy(*keys).applyInPandas(of_group, schema)


def inverted_index(df: DataFrame, id_col: str, text_col: str, kind: str = "standard") -> DataFrame:
    """``token, row_id, n``: a row for each token and row that has it. A common token is many rows, not one long list."""
    each = df.select(F.col(id_col).alias("row_id"), F.explode(tokens(F.col(text_col), kind)).alias("token"))
    return each.groupBy("token", "row_id").agg(F.count("*").alias("n"))


@dataclass
class TimedCache:
    """Driver-side entries with a time to live between bounds, validators, stale use while renewing, and least-recent eviction."""

    size: int = 1000
    least_ttl: float = 1.0
    most_ttl: float = 86_400.0
    stale_seconds: float = 0.0
    clock: object = time.monotonic
    entries: OrderedDict = field(default_factory=OrderedDict)

    def put(self, key, value, ttl: float, etag: str | None = None) -> None:
        until = self.clock() + min(max(ttl, self.least_ttl), self.most_ttl)
        self.entries[key] = (value, until, etag)
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

    def get(self, key) -> tuple[object, str]:
        """Value and ``fresh``, ``stale`` or ``miss``; what is too old even for stale use goes."""
        if key not in self.entries:
            return None, "miss"
        value, until, _ = self.entries[key]
        now = self.clock()
        if now > until + self.stale_seconds:
            del self.entries[key]
            return None, "miss"
        self.entries.move_to_end(key)
        return value, "fresh" if now <= until else "stale"

    def renew(self, key, etag: str | None, ttl: float) -> bool:
        """An entry whose validator still holds lives on."""
        if key in self.entries and etag is not None and self.entries[key][2] == etag:
            self.put(key, self.entries[key][0], ttl, etag)
            return True
        return False
