"""Everything that can be reached over links, round by round, joining only what the last round found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging

#: Rounds, that is links in a row, after which the closure is an error.
MOST_ROUNDS = 1000
#: Small rounds are gathered and written together once there are so many of them.
GATHERED = 16


def closure(links: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, steps``: every pair with a way from the one to the other, and the fewest links of such a way.

    Semi-naive: a round joins the pairs that the round before found with the links, and keeps those that no round has
    found yet. Each round is written, so a lost executor costs no more than a round. Links with a null end lead nowhere;
    repeated links count once; on a cycle a node reaches itself. An empty table gives an empty result.
    """
    spark = links.sparkSession
    one = staging.staged(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "links")
    schema = one.withColumn("steps", F.lit(1)).schema
    known, new = [staging.write(one.withColumn("steps", F.lit(1)), "round")], one
    read = lambda paths: spark.read.schema(schema).parquet(*paths)
    for k in range(2, MOST_ROUNDS):
        found = new.join(one.withColumnsRenamed({"a": "via", "b": "to"}), F.col("b") == F.col("via")).select("a", F.col("to").alias("b")).distinct()
        path = staging.write(found.join(read(known), ["a", "b"], "left_anti").withColumn("steps", F.lit(k)), "round")
        fresh = read([path])
        if fresh.isEmpty():
            staging.drop(spark, path)
            return read(known)
        known, new = [*known, path], fresh.select("a", "b")
        if len(known) > GATHERED:
            whole = staging.write(read(known[:-1]), "round")
            for old in known[:-1]:
                staging.drop(spark, old)
            known = [whole, path]
    raise RuntimeError("the closure did not settle")
