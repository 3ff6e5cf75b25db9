"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, read_staged, write_staged

#: More rounds than this mean a fault: the rounds grow with the logarithm of the nodes.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges run from the larger to the smaller node."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def components(links: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, root`` for every node with a link, ``root`` the smallest node of its component.

    Every round is written to the shared folder and the one before it deleted, so lineage and disk stay bounded and
    nothing but two numbers a round comes to the driver. Loops and repeated links do no harm; no links give no rows.
    Minima are combined before the shuffle, and hubs only ever meet a join that can be split.
    """
    spark = links.sparkSession
    edges = links.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).cast("long").alias("src"), F.least(src, dst).cast("long").alias("dst")).distinct()
    path = write_staged(edges, "edges")
    now, before = read_staged(spark, path, edges), None
    for _ in range(MOST_ROUNDS):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
        before = state
        following = _small_star(_large_star(now))
        new_path = write_staged(following, "edges")
        drop_staged(spark, path)
        path, now = new_path, read_staged(spark, new_path, following)
    raise RuntimeError("the components did not settle")
