"""Comparing two versions of the orders table, applying the changes, and column encodings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as d
from ..operators import encode as e
from ..operators import staging
from ..sources import csv_sink
from .registry import query, table

_OLD = "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders"
_NEW = "SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 7 <> 0"


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Old orders; new ones with every seventh gone, every third changed and every eleventh under a new key."""
    o = table(spark, sf, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    moved = F.when(F.col("id") % 11 == 0, F.col("id") + 100_000_000).otherwise(F.col("id"))
    new = old.where("id % 7 <> 0").select(moved.alias("id"), F.when(F.col("id") % 3 == 0, F.lower("status")).otherwise(F.col("status")).alias("status"), "priority")
    return old, new


@query(f"""SELECT CASE WHEN a.id IS NULL THEN 'INSERT' WHEN b.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, coalesce(a.id, b.id) AS id, a.status AS old_status, b.status AS new_status
FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status""")
def diff_by_key(spark, sf):
    old, new = versions(spark, sf)
    changes = d.diff(old, new, d.DiffConfig("key_based"))
    return changes.select("op", F.coalesce(F.get("old", F.lit(0)), F.get("new", F.lit(0))).cast("long").alias("id"), F.get("old", F.lit(1)).alias("old_status"), F.get("new", F.lit(1)).alias("new_status"))


@query(f"""WITH a AS ({_OLD}), b AS ({_NEW}) SELECT 'INSERT' AS op, id, status FROM b WHERE (id, status, priority) NOT IN (SELECT id, status, priority FROM a)
UNION ALL SELECT 'DELETE', id, status FROM a WHERE (id, status, priority) NOT IN (SELECT id, status, priority FROM b)""")
def diff_by_content(spark, sf):
    old, new = versions(spark, sf)
    row = F.coalesce("new", "old")
    return d.diff(old, new).select("op", F.get(row, F.lit(0)).cast("long").alias("id"), F.get(row, F.lit(1)).alias("status"))


@query(f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM ({_OLD})), b AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM ({_NEW}))
SELECT CASE WHEN a.id IS NULL THEN 'INSERT' WHEN b.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, coalesce(a.pos, b.pos) AS pos,
CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.id <> b.id THEN '0' END, CASE WHEN a.status <> b.status THEN '1' END, CASE WHEN a.priority <> b.priority THEN '2' END) END AS changed
FROM a FULL JOIN b ON a.pos = b.pos WHERE a.id IS NULL OR b.id IS NULL OR a.id <> b.id OR a.status <> b.status OR a.priority <> b.priority""")
def diff_by_position(spark, sf):
    old, new = versions(spark, sf)
    changes = d.diff(old, new, d.DiffConfig("field_by_field", order="id"))
    return changes.select("op", F.col("row_index").alias("pos"), F.array_join(F.transform("changed", lambda i: i.cast("string")), ",").alias("changed"))


@query(f"""SELECT op, count(*) AS n FROM (SELECT CASE WHEN a.id IS NULL THEN 'INSERT' WHEN b.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status) GROUP BY op""")
def diff_statistics(spark, sf):
    old, new = versions(spark, sf)
    return d.statistics(d.diff(old, new, d.DiffConfig("key_based")))


@query(_NEW)
def diff_apply(spark, sf):
    """The old version and the changes give the new version."""
    old, new = versions(spark, sf)
    return d.apply(old, d.diff(old, new, d.DiffConfig("key_based")))


@query(f"SELECT id FROM ({_OLD}) a WHERE id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM ({_NEW}) b WHERE b.id = a.id AND b.status = a.status)")
def diff_damage(spark, sf):
    """Changes whose old cells no longer fit their hash: those of every fifth key."""
    old, new = versions(spark, sf)
    changes = d.diff(old, new, d.DiffConfig("key_based")).where("old is not null")
    key = F.get("old", F.lit(0)).cast("long")
    spoilt = changes.withColumn("old", F.when(key % 5 == 0, F.array(F.get("old", F.lit(0)), F.lit(None).cast("string"), F.get("old", F.lit(2)))).otherwise(F.col("old")))
    return d.damaged(spoilt).select(F.get_json_object("key", "$.id").cast("long").alias("id"))


_OLD_BAG = "SELECT o_orderstatus AS status, nullif(o_orderpriority, '5-LOW') AS priority FROM orders"
_NEW_BAG = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || '|' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN coalesce(nullif(o_orderpriority, '5-LOW'), '') ELSE nullif(o_orderpriority, '5-LOW') END AS priority FROM orders WHERE o_orderkey % 7 <> 0"


def bags(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Rows that repeat, with nulls, empty cells and bars, and no key."""
    o = table(spark, sf, "orders")
    priority = F.nullif("o_orderpriority", F.lit("5-LOW"))
    old = o.select(F.col("o_orderstatus").alias("status"), priority.alias("priority"))
    status = F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderstatus", F.lit("|"))).otherwise(F.col("o_orderstatus"))
    new = o.where("o_orderkey % 7 <> 0").select(status.alias("status"), F.when(F.col("o_orderkey") % 5 == 0, F.coalesce(priority, F.lit(""))).otherwise(priority).alias("priority"))
    return old, new


@query(_NEW_BAG)
def diff_apply_content(spark, sf):
    """The default mode restores the new version also where rows repeat."""
    old, new = bags(spark, sf)
    return d.apply(old, d.diff(old, new))


@query(f"""SELECT op, status, priority, n FROM (SELECT CASE WHEN coalesce(b.n, 0) > coalesce(a.n, 0) THEN 'INSERT' ELSE 'DELETE' END AS op, coalesce(a.status, b.status) AS status, coalesce(a.priority, b.priority) AS priority, abs(coalesce(b.n, 0) - coalesce(a.n, 0)) AS n
FROM (SELECT status, priority, count(*) AS n FROM ({_OLD_BAG}) GROUP BY ALL) a FULL JOIN (SELECT status, priority, count(*) AS n FROM ({_NEW_BAG}) GROUP BY ALL) b ON a.status IS NOT DISTINCT FROM b.status AND a.priority IS NOT DISTINCT FROM b.priority) WHERE n > 0""")
def diff_repeated_content(spark, sf):
    old, new = bags(spark, sf)
    row = F.coalesce("new", "old")
    return d.diff(old, new).groupBy("op", F.get(row, F.lit(0)).alias("status"), F.get(row, F.lit(1)).alias("priority")).agg(F.count("*").alias("n"))


@query(_NEW)
def diff_by_position_apply(spark, sf):
    old, new = versions(spark, sf)
    return d.apply(old, d.diff(old, new, d.DiffConfig("field_by_field", order="id")))


@query("SELECT o_orderkey AS id, old_version, new_version FROM (SELECT o_orderkey, o_orderkey % 13 AS old_version, o_orderkey % 17 AS new_version FROM orders) WHERE new_version > old_version")
def diff_by_timestamp(spark, sf):
    """Only later versions count, and a later one is a greater number, not a greater text."""
    o = table(spark, sf, "orders")
    version = lambda n: o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % n).cast("string").alias("version"))
    changes = d.diff(version(13), version(17), d.DiffConfig("timestamp_based", timestamp="version"))
    return changes.select(F.get("new", F.lit(0)).cast("long").alias("id"), F.get("old", F.lit(1)).cast("long").alias("old_version"), F.get("new", F.lit(1)).cast("long").alias("new_version"))


_FIRST = "SELECT {name} AS name, min(pos) AS pos FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM customer) GROUP BY 1"


@query(f"SELECT a.name, a.pos AS row_index, b.pos AS new_index FROM ({_FIRST.format(name='c_name', order='c_custkey')}) a JOIN ({_FIRST.format(name='c_name', order='c_custkey % 10, c_custkey')}) b ON a.name = b.name WHERE a.pos <> b.pos")
def diff_moves(spark, sf):
    c = table(spark, sf, "customer")
    old = c.select(F.col("c_custkey").alias("o"), F.lit(0).cast("long").alias("p"), F.col("c_name").alias("name"))
    new = c.select(F.lit(0).cast("long").alias("o"), (F.col("c_custkey") % 10 * 10_000_000 + F.col("c_custkey")).alias("p"), F.col("c_name").alias("name"))
    return d.moves(old, new, "o", "p").select(F.get("old", F.lit(0)).alias("name"), "row_index", "new_index")


@query(f"SELECT op, count(*) AS n FROM (SELECT CASE WHEN a.id IS NULL THEN 'INSERT' WHEN b.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status) GROUP BY op")
def diff_file_round_trip(spark, sf):
    """Changes written, read, turned to lines and back, doubled and made unique again."""
    old, new = versions(spark, sf)
    path = f"{staging.shared_dir(spark)}/delta-{uuid.uuid4().hex}"
    d.write_delta(d.diff(old, new, d.DiffConfig("key_based")), path, old.columns)
    try:
        _, changes = d.read_delta(spark, path)
        again = d.from_json(d.to_json(changes))
        return staging.staged(d.statistics(d.sorted_unique(again.unionByName(again))), "kinds")
    finally:
        staging.drop(spark, path)


@query("SELECT 'UPDATE' AS op, n_nationkey::VARCHAR AS id, n_name AS old_name, lower(n_name) AS new_name FROM nation WHERE n_nationkey % 2 = 0")
def diff_csv_files(spark, sf):
    """Two CSV files compared by key."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    paths = [f"{staging.shared_dir(spark)}/{side}-{uuid.uuid4().hex}" for side in ("old", "new")]
    csv_sink.write_csv(n, paths[0])
    csv_sink.write_csv(n.withColumn("name", F.when(F.col("id") % 2 == 0, F.lower("name")).otherwise(F.col("name"))), paths[1])
    try:
        changes = d.diff_files(spark, *paths, d.DiffConfig("key_based"))
        return staging.staged(changes.select("op", F.get("old", F.lit(0)).alias("id"), F.get("old", F.lit(1)).alias("old_name"), F.get("new", F.lit(1)).alias("new_name")), "changes")
    finally:
        for p in paths:
            staging.drop(spark, p)


_RUNS = "SELECT user_id, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run, event_type FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"SELECT user_id, run::BIGINT AS run, event_type AS value, count(*) AS run_length FROM ({_RUNS}) GROUP BY ALL")
def encode_run_lengths(spark, sf):
    return e.run_lengths(table(spark, sf, "events"), "event_type", ["ts", "event_id"], ["user_id"]).withColumn("run", F.col("run").cast("long"))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS value FROM events")
def decode_run_lengths(spark, sf):
    runs = e.run_lengths(table(spark, sf, "events"), "event_type", ["ts", "event_id"], ["user_id"])
    return e.expand_runs(runs, ["user_id"])


@query("SELECT event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 4) AS delta FROM events")
def encode_differences(spark, sf):
    return e.differences(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", F.round("delta", 4).alias("delta"))


@query("SELECT event_id, round(value, 4) AS value FROM events")
def decode_differences(spark, sf):
    encoded = e.differences(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"]).drop("value")
    return e.sum_differences(encoded, ["ts", "event_id"], ["user_id"]).select("event_id", F.round("value", 4).alias("value"))


@query("SELECT event_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS code FROM events GROUP BY event_type")
def encode_dictionary(spark, sf):
    return e.dictionary(table(spark, sf, "events"), "event_type").withColumn("code", F.col("code").cast("long"))


@query("SELECT event_id, event_type FROM events")
def decode_dictionary(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    codes = e.dictionary(events, "event_type", 3)
    return e.decode(e.encode(events, "event_type", codes), "event_type", codes).select("event_id", "event_type")


_WIDER = f"SELECT *, CASE WHEN id % 5 = 0 THEN 'rush' END AS note FROM ({_NEW})"


@query(f"""SELECT CASE WHEN a.id IS NULL THEN 'INSERT' WHEN b.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, coalesce(a.id, b.id) AS id, b.note AS new_note,
CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.status <> b.status THEN '1' END, CASE WHEN b.note IS NOT NULL THEN '3' END) END AS changed
FROM ({_OLD}) a FULL JOIN ({_WIDER}) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status OR b.note IS NOT NULL""")
def diff_added_column(spark, sf):
    """A column that only the new version has is a change of the rows that fill it."""
    old, new = versions(spark, sf)
    changes = d.diff(old, new.withColumn("note", F.when(F.col("id") % 5 == 0, "rush")), d.DiffConfig("key_based"))
    id_of = F.coalesce(F.get("old", F.lit(0)), F.get("new", F.lit(0))).cast("long")
    return changes.select("op", id_of.alias("id"), F.get("new", F.lit(3)).alias("new_note"), F.array_join(F.transform("changed", lambda i: i.cast("string")), ",").alias("changed"))


@query(f"SELECT id, note, status FROM ({_WIDER})")
def diff_columns_apply(spark, sf):
    """Changes between versions with other columns, applied: one is new, one is gone, and their order differs."""
    old, new = versions(spark, sf)
    wider = new.withColumn("note", F.when(F.col("id") % 5 == 0, "rush")).select("id", "note", "status")
    return d.apply(old, d.diff(old, wider), wider)


@query()
def diff_fewest_moves(spark, sf):
    """Orders of few contents, with rows put on top and every 97th taken to the end: as few moves as possible, which SQL can't find; tested against brute force."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.floor("o_totalprice").alias("price"))
    price = F.when(F.col("o_orderkey") % 3 == 0, F.col("price") % 5).otherwise(F.col("price"))  # contents that repeat
    rows = o.select(F.col("o_orderkey").cast("long").alias("at"), price.alias("price"), "o_orderstatus")
    top = rows.where("at % 50 = 1").select((-F.col("at")).alias("at"), F.lit(-1).cast("long").alias("price"), "o_orderstatus")
    later = rows.withColumn("at", F.when(F.col("at") % 97 == 0, F.col("at") + (1 << 40)).otherwise(F.col("at")))
    return d.fewest_moves(rows, top.unionByName(later), "at", "at").select("row_index", "new_index", F.get("old", F.lit(0)).alias("price"))
