"""Merging two overlapping versions of the customer table, and fuzzy clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as m
from .registry import query, table

_A = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 5) DAY AS ts, 0 AS ord, 1 AS priority FROM customer WHERE c_custkey % 3 <> 0"
_B = "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || ' ' END AS name, c_mktsegment AS segment, c_acctbal + 1 AS balance, TIMESTAMP '2024-01-03' AS ts, 1 AS ord, 2 AS priority FROM customer WHERE c_custkey % 4 <> 0"
_BOTH = f"({_A} UNION ALL {_B})"


def sources(spark: SparkSession, sf: str) -> list[m.Source]:
    """Two overlapping halves; the second has changed balances and trailing spaces in some names."""
    c = table(spark, sf, "customer")
    cols = [F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")]
    day = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval((F.col("c_custkey") % 5).cast("int"))
    a = c.where("c_custkey % 3 <> 0").select(*cols, day.alias("ts"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit(" ")))
    b = c.where("c_custkey % 4 <> 0").select(cols[0], name.alias("name"), cols[2], (F.col("c_acctbal") + 1).alias("balance"), F.to_timestamp(F.lit("2024-01-03")).alias("ts"))
    return [m.Source("a", a, 1, "ts"), m.Source("b", b, 2, "ts")]


def _merged(spark: SparkSession, sf: str, **config) -> DataFrame:
    return m.merge(sources(spark, sf), m.MergeConfig(**config)).select("id", "name", "segment", F.round("balance", 2).alias("balance"))


def _first(order: str, key: str = "id") -> str:
    return f"SELECT id, name, segment, round(balance, 2) AS balance FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {_BOTH}) WHERE k = 1"


@query(f"SELECT id, name, segment, round(balance, 2) AS balance FROM {_BOTH}")
def merge_append(spark, sf):
    return _merged(spark, sf, strategy="append")


@query(_first("ord"))
def merge_keep_first(spark, sf):
    return _merged(spark, sf, resolve="first")


@query(_first("ord DESC"))
def merge_keep_last(spark, sf):
    return _merged(spark, sf, resolve="last")


@query(_first("ts DESC, ord DESC"))
def merge_keep_newest(spark, sf):
    return _merged(spark, sf, strategy="time")


@query(_first("ts, ord"))
def merge_keep_oldest(spark, sf):
    return _merged(spark, sf, resolve="oldest")


@query(_first("priority DESC, ord"))
def merge_priority(spark, sf):
    return _merged(spark, sf, strategy="priority")


@query(f"""SELECT key, name, segment FROM (SELECT id AS key, name, segment, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM (SELECT lower(trim(name)) AS id, name, segment, ord FROM {_BOTH})) WHERE k = 1""")
def merge_trimmed_key(spark, sf):
    """Keys trimmed and without case: names with a trailing space are the same key."""
    a, b = sources(spark, sf)
    out = m.merge([a, b], m.MergeConfig(keys=("name",), case_sensitive=False, resolve="first"))
    return out.select(F.lower(F.trim("name")).alias("key"), "name", "segment")


@query(f"SELECT DISTINCT name, segment FROM {_BOTH}")
def merge_exact_dedup(spark, sf):
    return m.merge([m.Source(s.name, s.rows.select("name", "segment")) for s in sources(spark, sf)], m.MergeConfig(dedup="exact", resolve="first"))


@query(f"SELECT DISTINCT segment, id % 10 AS tail FROM {_BOTH}")
def merge_hash_dedup(spark, sf):
    return m.merge([m.Source(s.name, s.rows.select("segment", (F.col("id") % 10).alias("tail"))) for s in sources(spark, sf)], m.MergeConfig(dedup="hash", resolve="first"))


@query(f"""WITH r AS (SELECT id, name, segment FROM {_BOTH}),
n AS (SELECT id, name AS v, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, name) AS k FROM r GROUP BY id, name),
s AS (SELECT id, segment AS v, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, segment) AS k FROM r GROUP BY id, segment)
SELECT n.id, n.v AS name, s.v AS segment FROM n JOIN s ON n.id = s.id WHERE n.k = 1 AND s.k = 1""")
def merge_values(spark, sf):
    """The most frequent value of each column, the least on ties."""
    out = m.merge([m.Source(s.name, s.rows.select("id", "name", "segment")) for s in sources(spark, sf)], m.MergeConfig(resolve="merge_values"))
    return out.select("id", "name", "segment")


@query("SELECT n_nationkey AS id, n_name AS name, '' AS balance FROM nation UNION ALL SELECT s_suppkey, '', CAST(s_suppkey AS VARCHAR) FROM supplier")
def merge_schema_union(spark, sf):
    """Sources with different columns: all columns, blanks for what is missing."""
    a = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("balance"))
    return m.merge([m.Source("a", a), m.Source("b", b)], m.MergeConfig(strategy="schema", dedup="none")).na.fill("")


_NAME = "upper(p_brand || ' ' || p_name || CASE p_partkey % 4 WHEN 1 THEN 's' ELSE '' END)"


@query(f"""WITH RECURSIVE t AS (SELECT p_partkey AS id, p_size AS block, {_NAME} AS name FROM part),
u AS (SELECT block, name, min(id) AS id FROM t GROUP BY ALL),
g AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(name), 1)), lambda i: substr(name, i, 2))) AS grams FROM u),
e AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.block = b.block AND a.id <> b.id
 AND 0.7 * (1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))) + 0.3 * len(list_intersect(a.grams, b.grams)) / len(list_distinct(list_concat(a.grams, b.grams))) >= 0.85),
w(id, reach) AS (SELECT id, id FROM u UNION SELECT w.id, e.b FROM w JOIN e ON w.reach = e.a)
SELECT t.id, min(w.reach) AS cluster FROM t JOIN u ON t.block = u.block AND t.name = u.name JOIN w ON w.id = u.id GROUP BY t.id""")
def fuzzy_clusters(spark, sf):
    """Part names, some in the plural, that are alike within a size."""
    name = F.upper(F.concat("p_brand", F.lit(" "), "p_name", F.when(F.col("p_partkey") % 4 == 1, "s").otherwise("")))
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("block"), name.alias("name"))
    return m.fuzzy_clusters(t, "id", ["name"], ["block"])


_CELLS = "SELECT c_mktsegment || '|' AS a, c_nationkey::VARCHAR AS b FROM customer UNION ALL SELECT c_mktsegment, '|' || c_nationkey FROM customer UNION ALL SELECT c_mktsegment, NULL FROM customer UNION ALL SELECT c_mktsegment, '' FROM customer"


def _cells(spark: SparkSession, sf: str) -> list[m.Source]:
    """Rows that are alike only where bars and nulls aren't told apart."""
    c = table(spark, sf, "customer")
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    pairs = [(F.concat(segment, F.lit("|")), nation), (segment, F.concat(F.lit("|"), nation)), (segment, F.lit(None).cast("string")), (segment, F.lit(""))]
    return [m.Source(str(k), c.select(a.alias("a"), b.alias("b"))) for k, (a, b) in enumerate(pairs)]


@query(f"SELECT DISTINCT a, b FROM ({_CELLS})")
def merge_hash_collision(spark, sf):
    return m.merge(_cells(spark, sf), m.MergeConfig(dedup="hash"))


@query(f"SELECT a, coalesce(b, '') AS b, count(*) AS n FROM (SELECT DISTINCT a, coalesce(b, '') AS b FROM ({_CELLS})) GROUP BY ALL")
def merge_key_of_two_columns(spark, sf):
    """Keys of two columns keep the columns apart; null and empty cells are one key."""
    return m.merge(_cells(spark, sf), m.MergeConfig(keys=("a", "b"))).groupBy("a", F.coalesce("b", F.lit("")).alias("b")).agg(F.count("*").alias("n"))


_ODD = f"SELECT CASE WHEN id % 10 = 0 THEN NULL ELSE id END AS id, name AS _row, balance AS _ts FROM {_BOTH}"


@query(f"SELECT id, _row, round(_ts, 2) AS _ts FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _ts DESC, _row) AS k FROM ({_ODD})) WHERE k = 1 OR id IS NULL")
def merge_custom(spark, sf):
    """A resolver of one's own: the greatest balance. Rows without a key stay, and columns named like the merge's own notes are kept."""
    odd = [m.Source(s.name, s.rows.select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("id"), F.col("name").alias("_row"), F.col("balance").alias("_ts"))) for s in sources(spark, sf)]
    greatest = lambda rows, key: rows.sort_values([key, "_ts", "_row"], ascending=[True, False, True]).drop_duplicates(key)
    return m.merge(odd, m.MergeConfig(resolve="custom", resolve_many=greatest)).select("id", "_row", F.round("_ts", 2).alias("_ts"))


@query(f"SELECT 'a' AS source, count(*) AS rows FROM ({_A}) UNION ALL SELECT 'b', count(*) FROM ({_B}) UNION ALL SELECT 'merged', count(DISTINCT id) FROM ({_BOTH})")
def merge_counters(spark, sf):
    """Rows in and out, counted by the merging job itself."""
    merged, told = m.counted(sources(spark, sf), m.MergeConfig(keys=("id",)))
    merged.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(list(told().items()), "source string, rows long")
