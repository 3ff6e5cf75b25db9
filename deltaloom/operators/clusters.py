"""Clusters of linked rows: every node takes the least label around it, labels are shortened, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging

MOST_ROUNDS = 100


def clusters(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, cluster`` for every node of a link, ``cluster`` the least node it reaches."""
    spark = links.sparkSession
    both = staging.staged(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).where("x <> y").distinct(), "links")
    labels = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("cluster"))
    path = None
    for _ in range(MOST_ROUNDS):
        new_path = staging.write(labels, "labels")
        now = spark.read.schema(labels.schema).parquet(new_path)
        if path:
            staging.drop(spark, path)
        path = new_path
        near = both.join(now, both["y"] == now["node"]).groupBy("x").agg(F.min("cluster").alias("m"))
        least = now.join(near, now["node"] == near["x"]).select("node", F.least("cluster", "m").alias("cluster"), F.col("cluster").alias("old"))
        jump = now.select(F.col("node").alias("via"), F.col("cluster").alias("far"))
        following = least.join(jump, least["cluster"] == jump["via"]).select("node", F.least("cluster", "far").alias("cluster"), "old")
        marked = staging.staged(following, "moved")
        if marked.where("cluster <> old").isEmpty():
            return marked.select("node", "cluster")
        labels = marked.select("node", "cluster")
    raise RuntimeError("the clusters did not settle")
