"""Validation of rows against schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate as v
from .registry import query, table

ORDERS = v.Schema("orders", "1.0.0", [
    v.Field("o_orderkey", "INTEGER", low=1),
    v.Field("o_orderstatus", "ENUM", values=("F", "O")),
    v.Field("o_totalprice", "FLOAT", low=5000, high=400000),
    v.Field("o_orderpriority", "STRING", low=5, high=12, pattern=r"\d-.*"),
])
_FAULTS = """SELECT o_orderkey, unnest([CASE WHEN o_orderkey < 1 THEN 'o_orderkey|too small' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus|not an allowed value' END,
CASE WHEN o_totalprice < 5000 THEN 'o_totalprice|too small' END, CASE WHEN o_totalprice > 400000 THEN 'o_totalprice|too large' END,
CASE WHEN length(o_orderpriority) < 5 THEN 'o_orderpriority|too short' END, CASE WHEN length(o_orderpriority) > 12 THEN 'o_orderpriority|too long' END]) AS e FROM orders"""


def _text(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cells of text; decimals are written out, as a CSV has them."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderstatus", F.format_string("%.2f", "o_totalprice").alias("o_totalprice"), "o_orderpriority")


@query(f"SELECT o_orderkey, split_part(e, '|', 1) AS field, split_part(e, '|', 2) AS message FROM ({_FAULTS}) WHERE e IS NOT NULL")
def validation_errors(spark, sf):
    return v.error_rows(_text(spark, sf), ORDERS, ["o_orderkey"]).select("o_orderkey", "field", "message")


@query(f"SELECT split_part(e, '|', 1) AS field, split_part(e, '|', 2) AS message, count(*) AS n FROM ({_FAULTS}) WHERE e IS NOT NULL GROUP BY 1, 2")
def validation_report(spark, sf):
    return v.report(_text(spark, sf), ORDERS)


@query(f"WITH f AS (SELECT * FROM ({_FAULTS}) WHERE e IS NOT NULL) SELECT (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FROM orders) - (SELECT count(DISTINCT o_orderkey) FROM f) AS valid_rows, (SELECT count(*) FROM f) AS errors, round(100.0::DOUBLE * ((SELECT count(*) FROM orders) - (SELECT count(DISTINCT o_orderkey) FROM f)) / (SELECT count(*) FROM orders), 4) AS success_percent")
def validation_summary(spark, sf):
    s = v.summary(_text(spark, sf), ORDERS)
    return s.withColumn("success_percent", F.round("success_percent", 4))


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_FAULTS}) WHERE e IS NOT NULL)")
def validation_valid_rows(spark, sf):
    return v.valid_rows(_text(spark, sf), ORDERS).select("o_orderkey")


@query(r"""SELECT page_id, regexp_full_match(url, 'https?://[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}(/.*)?') AS ok FROM pages""")
def validate_urls(spark, sf):
    schema = v.Schema("pages", "1.0.0", [v.Field("url", "URL")])
    return v.with_errors(table(spark, sf, "pages").select("page_id", "url"), schema).select("page_id", (F.size("errors") == 0).alias("ok"))


_SHAPES = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'a.b+' || event_id || '@example.org' WHEN 1 THEN '10.0.' || event_id % 300 || '.1' WHEN 2 THEN '2024-0' || event_id % 9 || '-11' WHEN 3 THEN '2024-01-05T10:00:00Z' WHEN 4 THEN '123e4567-e89b-12d3-a456-426614174000' WHEN 5 THEN 'yes' ELSE 'N/A' END AS cell FROM events"


@query(f"""SELECT event_id, regexp_full_match(cell, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}') AS email,
(regexp_full_match(cell, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') AND try_cast(split_part(cell, '.', 3) AS INT) <= 255) OR regexp_full_match(cell, '[0-9a-fA-F:]{{2,39}}') AS ip,
regexp_full_match(cell, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(cell AS DATE) IS NOT NULL AS day, regexp_full_match(cell, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?') AS moment,
regexp_full_match(cell, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') AS uuid, lower(cell) IN ('true', '1', 'yes', 'y', 'on', 'false', '0', 'no', 'n', 'off') AS flag, cell IN ('', 'NULL', 'null', 'N/A') AS empty FROM ({_SHAPES})""")
def validate_shapes(spark, sf):
    """The checks of each type on cells of every shape."""
    k, n = F.col("event_id") % 7, F.col("event_id")
    chain = F.when(k == 0, F.concat(F.lit("a.b+"), n.cast("string"), F.lit("@example.org"))).when(k == 1, F.concat(F.lit("10.0."), (n % 300).cast("string"), F.lit(".1"))).when(k == 2, F.concat(F.lit("2024-0"), (n % 9).cast("string"), F.lit("-11")))
    cell = chain.when(k == 3, "2024-01-05T10:00:00Z").when(k == 4, "123e4567-e89b-12d3-a456-426614174000").when(k == 5, "yes").otherwise("N/A")
    cells = table(spark, sf, "events").select("event_id", cell.alias("cell"))
    ok = {a: ~v.checks(v.Field("cell", kind))[0][0](F.col("cell")) for a, kind in (("email", "EMAIL"), ("ip", "IP"), ("day", "DATE"), ("moment", "DATETIME"), ("uuid", "UUID"), ("flag", "BOOLEAN"))}
    return cells.select("event_id", *(c.alias(a) for a, c in ok.items()), v.is_empty(v.trimmed(F.col("cell"))).alias("empty"))
