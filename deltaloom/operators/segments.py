"""Pairs of like texts by a partition index: texts within an edit distance share a segment near the same place.

A text within distance t of another keeps at least one of t + 1 segments of it unchanged, and that segment moves by a few
characters at most. So the segments of every text are index keys, and the longer text of a pair is looked up by its
substrings in the windows where a segment may lie. Keys are 64-bit hashes; what meets by chance is ruled out by the
comparison that follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least edit similarity that the index is used for; below it segments are single characters.
LEAST = 0.2


def edit_candidates(values: DataFrame, least: float) -> DataFrame:
    """``a, b`` (``a < b``, each pair once): ids of texts of a block that may have an edit similarity of ``least`` or more; none is missed.

    ``values`` has ``id, block, text``; blocks and texts aren't null. Similarity is one less the distance over the longer
    length. The work for a text grows with the cube of the distance allowed, so texts should have at most a few hundred characters.
    """
    if not LEAST <= least <= 1:
        raise ValueError(f"the similarity must be from {LEAST} to 1")
    share = 1 - least
    most = lambda n: f"int(floor({share!r} * {n} + 1e-9))"  # noqa: E731  distance allowed at a longer length
    # Segment i of t + 1 over l characters: the last l mod (t + 1) segments are one longer.
    size = lambda l, t, i: f"(int({l} div ({t} + 1)) + if({i} >= {t} + 1 - {l} % ({t} + 1), 1, 0))"  # noqa: E731, E741
    start = lambda l, t, i: f"({i} * int({l} div ({t} + 1)) + greatest(0, {i} - ({t} + 1 - {l} % ({t} + 1))))"  # noqa: E731, E741
    v = values.select("id", "block", "text", F.length("text").alias("n"))

    longest = f"int(floor(n / {least!r} + 1e-9))"  # no longer text is close enough
    by_t = v.withColumn("t", F.explode(F.expr(f"sequence({most('n')}, {most(longest)})")))
    segments = by_t.withColumn("i", F.explode(F.expr("sequence(0, t)")))
    index = segments.select(F.expr(f"xxhash64(block, n, t, i, substring(text, {start('n', 't', 'i')} + 1, {size('n', 't', 'i')}))").alias("key"), F.col("id").alias("a"))

    looked = v.withColumn("t", F.expr(most("n"))).withColumn("l", F.explode(F.expr("sequence(n - t, n)"))).withColumn("i", F.explode(F.expr("sequence(0, t)")))
    looked = looked.withColumn("at", F.expr(start("l", "t", "i"))).withColumn("k", F.expr(size("l", "t", "i")))
    low, high = "greatest(0, at - i, at + n - l - (t - i))", "least(n - k, at + i, at + n - l + (t - i))"
    windows = looked.withColumn("p", F.explode(F.expr(f"if({low} <= {high}, sequence({low}, {high}), array())")))
    probes = windows.select(F.expr("xxhash64(block, l, t, i, substring(text, p + 1, k))").alias("key"), F.col("id").alias("b")).distinct()
    return index.join(probes, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
