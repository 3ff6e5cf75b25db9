"""Exact duplicates: an immutable snapshot screened by static filters, and a new batch.

The digests of the snapshot are dealt into buckets; each has a static binary-fuse filter. Distinct digests of the new
batch are looked up in their bucket's filter. Only positives join the snapshot's exact digests; the rest can't be in
the snapshot and are grouped among themselves. Digests with several rows are then checked byte by byte: their texts
are grouped as they are. Two texts under one digest would be told apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse_filter
from .common import WHITESPACE, fresh, lasting, small, staged, without_ids

#: Distinct digests of a bucket, about; the number of buckets follows from the counted digests.
BUCKET_DIGESTS = 1 << 16


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _keys(digests) -> np.ndarray:
    return np.array([int.from_bytes(bytes(d)[:8].ljust(8, b"\0"), "little") for d in digests], dtype=np.uint64)


def snapshot_filters(snapshot: DataFrame, n_buckets: int) -> DataFrame:
    """``bucket, filter`` over the distinct digests in column ``digest``; a bucket holds about BUCKET_DIGESTS of them by their hash."""
    return snapshot.select(_bucket(n_buckets), "digest").groupBy("bucket").applyInPandas(_build, "bucket long, filter binary")


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "filter": [fuse_filter.build(_keys(rows["digest"]))]})


def screen(incoming: DataFrame, filters: DataFrame, n_buckets: int) -> DataFrame:
    """The digests in ``incoming`` that the filters can't rule out."""
    asked = incoming.select(_bucket(n_buckets), "digest")
    return asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_probe, "digest binary")


def _probe(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    if asked.empty or shard.empty:
        return asked.iloc[:0][["digest"]]
    return asked.loc[fuse_filter.contains(bytes(shard["filter"].iloc[0]), _keys(asked["digest"])), ["digest"]]


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).alias("bucket")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", snapshot_upto: int | None = None, digest=sha256) -> DataFrame:
    """Groups of equal normalised texts.

    The snapshot is the rows with an id up to ``snapshot_upto`` (by default the middle of the range of ids), the new
    batch all others, null ids included. Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row for each
    input row. A null text counts as empty. ``keep_id`` is the smallest id of the group (null only if all are null).
    Of rows that repeat both id and text one is kept, whichever; so exactly one row of each group is kept. Further
    columns of ``docs`` aren't read. An empty table gives an empty result. ``digest`` maps the normalised text to a
    binary column; a weak one slows the check of bytes but changes no result but ``text_sha256``.
    """
    return lasting(docs.sparkSession, "exact", lambda: _groups(docs, id_col, text_col, snapshot_upto, digest))


def _groups(docs: DataFrame, id_col: str, text_col: str, snapshot_upto: int | None, digest) -> DataFrame:
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body"))
    per_id = staged(rows.select("doc_id", digest(F.col("body")).alias("digest")).groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digests")
    if snapshot_upto is None:
        low, high = per_id.agg(F.min("doc_id"), F.max("doc_id")).first()
        snapshot_upto = 0 if low is None else (low + high) // 2
    old = F.coalesce(F.col("doc_id") <= snapshot_upto, F.lit(False))
    grouped = [staged(per_id.where(c).groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("n")), name) for c, name in ((old, "snapshot"), (~old, "batch"))]
    snapshot, batch = grouped
    n_buckets = max(1, -(-max(snapshot.count(), batch.count()) // BUCKET_DIGESTS))
    filters = staged(snapshot_filters(snapshot, n_buckets), "filters")
    positives = screen(batch, filters, n_buckets)
    # A positive of the filter that the exact digests don't confirm is new, like the negatives.
    confirmed = staged(positives.join(batch, "digest").join(snapshot.select("digest"), "digest", "left_semi"), "confirmed")
    matched = confirmed.select("digest", F.col("n").alias("n_new"))
    groups = staged(
        snapshot.join(matched, "digest", "left").select("digest", "keep_id", (F.col("n") + F.coalesce("n_new", F.lit(0))).alias("n"))
        .unionByName(batch.join(confirmed.select("digest"), "digest", "left_anti")),
        "groups",
    )
    several = groups.where("n > 1").select("digest")
    suspects = rows.withColumn("digest", digest(F.col("body"))).join(small(several, several.count()), "digest", "left_semi")
    bodies = suspects.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    shared = staged(bodies.groupBy("digest").agg(F.count("*").alias("bodies")).where("bodies > 1").select("digest"), "shared")
    out = per_id.join(groups, "digest")
    n_shared = shared.count()
    if n_shared:
        # Different texts under one digest: those rows are grouped by their text instead.
        clash = small(shared, n_shared)
        apart = rows.withColumn("digest", digest(F.col("body"))).join(clash, "digest", "left_semi").groupBy("digest", "doc_id", "body").agg(F.count("*").alias("copies"))
        out = out.join(clash, "digest", "left_anti").unionByName(apart.join(bodies.join(clash, "digest", "left_semi"), ["digest", "body"]).drop("body"))
    return out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the smallest id. Columns stay as they are."""
    found = exact_duplicates(docs, id_col, text_col)
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return without_ids(docs, found.where("not kept").select("doc_id"), id_col)
    # Ids that several rows share don't name a row: decide by id and digest, and drop the repeats.
    stay = found.where("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_text"))
    body = fresh(docs, "row_text")
    marked = docs.withColumn(body, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    kept = marked.join(stay, marked[id_col].eqNullSafe(stay["stay_id"]) & (marked[body] == stay["stay_text"]), "left_semi")
    return kept.dropDuplicates([id_col, body]).select(*docs.columns)


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM t WINDOW g AS (PARTITION BY h)"""
