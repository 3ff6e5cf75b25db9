"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside this class; Java regular expression.
WHITESPACE = r"[\x20\x09-\x0D]+"

#: Rows up to which a table of ids or digests (at most 64 bytes a row) may be broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_if_any(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The table, or None where the folder has none (no such path, or no file below it); any other fault is an error."""
    try:
        return table(spark, sf_dir, name)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        own = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(own, exist_ok=True)
        return f"file://{own}"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


#: Paths written within each open scope, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving whatever was staged inside, also after an error. What was only read lazily from it is gone then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_staged(spark, path)


def lasting(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` staged; all that it staged on the way is deleted. The one table left belongs to the scope outside, if any."""
    with scope(spark):
        df = make()
        path = write_staged(df, name)
        _scopes[-1].remove(path)
    if _scopes:
        _scopes[-1].append(path)
    return read_staged(spark, path, df)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again: lineage ends there."""
    return read_staged(df.sparkSession, write_staged(df, name), df)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that the innermost scope deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def write_staged(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def read_staged(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def drop_staged(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound; otherwise as it is (shuffled join)."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as keep it from clashing with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(text: str | bytes | None) -> bytes:
    """The bytes of a text. Broken UTF-8 can only be handed to Python as binary: as a string it is an error there."""
    return text if isinstance(text, bytes) else (text or "").encode()


def decoded(data: bytes | None) -> str | None:
    """The text of some bytes, each broken part replaced by U+FFFD; null stays null."""
    return None if data is None else data.decode("utf-8", "replace")


#: Long texts are cut into words in pieces of about so many bytes.
PIECE_BYTES = 1 << 20


def pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces of bounded size that end between words; a longer word is a piece of its own with what stands before it."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        tail = text[at:end].rsplit(None, 1)
        while len(tail) < 2 and not text[end - 1 : end].isspace() and end < len(text):
            end = min(len(text), end + PIECE_BYTES)
            tail = text[at:end].rsplit(None, 1)
        if end < len(text) and not text[end - 1 : end].isspace() and not text[end : end + 1].isspace():
            end -= len(tail[-1])
        yield text[at:end]
        at = end
    yield text[at:]


def words_array(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITESPACE), lambda w: w != F.lit(""))


def without_ids(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the ids in ``removed`` (one column, distinct, may hold a null). Columns of ``docs`` stay as they are."""
    n = removed.count()
    gone = small(removed.select(F.col(removed.columns[0]).alias("_gone_id")), n)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]), "left_anti")


#: Rows and bytes of texts that are turned into Python objects at once; a single longer text is a chunk of its own.
CHUNK_ROWS, CHUNK_BYTES = 512, 8 << 20


def table_chunks(batches: Iterator[pa.RecordBatch], chunk_rows: int = CHUNK_ROWS) -> Iterator[dict[str, list]]:
    """Columns of the batches as Python lists, in slices of bounded rows and bytes."""
    for batch in batches:
        wide = [c for c in batch.columns if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_binary(c.type)]
        size = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in wide), np.zeros(batch.num_rows, np.int64))
        at = 0
        while at < batch.num_rows:
            sums = np.cumsum(size[at : at + chunk_rows])
            n = max(1, int(np.searchsorted(sums, CHUNK_BYTES, side="right")))
            yield batch.slice(at, n).to_pydict()
            at += n


#: Bytes of an Arrow batch handed to Python, unless the session has its own bound.
ARROW_BYTES_KEY, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand rows to Python in batches of bounded bytes, unless a bound is set there.

    Spark's own bound is 10,000 rows or 64 MB. Whole texts then make vectors of tens of megabytes outside the heap, and
    an executor's memory keeps growing by what the allocator holds back of them.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_BYTES_KEY, None) is None:
        conf.set(ARROW_BYTES_KEY, str(ARROW_BYTES))
    return df


def arrow_map(df: DataFrame, schema: str, per_chunk: Callable[[dict[str, list]], dict[str, list]], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Apply ``per_chunk`` (columns in, columns out) to slices of bounded rows and bytes of each Arrow batch.

    Strings are handed over as bytes, as broken UTF-8 can't be handed over as text, and decoded here; each broken part
    becomes U+FFFD. Binary columns stay bytes.
    """
    from pyspark.sql.types import StringType, StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in table_chunks(batches, chunk_rows):
            for name in texts:
                rows[name] = [decoded(t) for t in rows[name]]
            got = per_chunk(rows)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.select(*(F.col(f.name).cast("binary").alias(f.name) if f.name in texts else F.col(f.name) for f in bounded_batches(df).schema)).mapInArrow(run, schema)
