"""Column encodings as tables: run lengths, differences, frequency dictionaries, and their inverses.

Bytes on disk are left to Parquet, which picks such encodings for each chunk. ``partition`` columns keep an order from
being one task's: positions count within a partition. Result columns never overwrite columns of the table: a clash is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import fresh

#: Entries of a dictionary; rarer values stay plain, so that nothing is lost.
DICTIONARY_ENTRIES = 1000


def _check_free(columns: list[str], *made: str) -> None:
    taken = {c.lower() for c in columns} & {*made}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here; rename those of the table")


def run_lengths(df: DataFrame, column: str, order: list[str], partition: list[str]) -> DataFrame:
    """Runs of equal neighbours: partition, ``run, value, run_length``."""
    _check_free(partition, "run", "value", "run_length")
    w = Window.partitionBy(*partition).orderBy(*order)
    opens = F.when(F.col(column).eqNullSafe(F.lag(column).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    first, run = fresh(df.columns, "opens"), fresh(df.columns, "run")
    marked = df.withColumn(first, opens).withColumn(run, F.sum(first).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*partition, F.col(run).alias("run")).agg(F.first(column).alias("value"), F.count("*").alias("run_length"))


def expand_runs(runs: DataFrame, partition: list[str]) -> DataFrame:
    """partition, ``pos, value``: the inverse of run lengths, positions from 1."""
    before = F.coalesce(F.sum("run_length").over(Window.partitionBy(*partition).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    _check_free(partition, "pos", "value")
    at = fresh(runs.columns, "before")
    return runs.withColumn(at, before).select(*partition, F.explode(F.sequence(F.col(at) + 1, F.col(at) + F.col("run_length"))).alias("pos"), "value")


def differences(df: DataFrame, column: str, order: list[str], partition: list[str]) -> DataFrame:
    """``df`` with ``delta``: the first value, then each value less the one before."""
    _check_free(df.columns, "delta")
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("delta", F.col(column) - F.coalesce(F.lag(column).over(w), F.lit(0)))


def sum_differences(df: DataFrame, order: list[str], partition: list[str], column: str = "value") -> DataFrame:
    return df.withColumn(column, F.sum("delta").over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def dictionary(df: DataFrame, column: str, entries: int = DICTIONARY_ENTRIES) -> DataFrame:
    """``value, code, n``: the most frequent values, code 0 the most frequent, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(entries)
    return top.withColumn("code", F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1)  # at most `entries` rows


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``df`` with ``code``, and ``rest`` for values outside the dictionary."""
    _check_free(df.columns, "code", "rest")
    v = fresh(df.columns, "entry")
    c = F.broadcast(codes.select(F.col("value").alias(v), "code"))
    return df.join(c, F.col(column) == F.col(v), "left").withColumn("rest", F.when(F.col("code").isNull(), F.col(column))).drop(v, column)


def decode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    _check_free(df.columns, column.lower())
    taken = [*df.columns, column]
    k, v = fresh(taken, "entry_code"), fresh(taken, "entry")
    c = F.broadcast(codes.select(F.col("code").alias(k), F.col("value").alias(v)))
    return df.join(c, F.col("code") == F.col(k), "left").withColumn(column, F.coalesce(v, "rest")).drop(k, v, "code", "rest")


def best_encoding(df: DataFrame, column: str, order: list[str], partition: list[str]) -> DataFrame:
    """``encoding, cells`` by estimate of cells to store, the least first: plain, run lengths (two a run), dictionary (codes at a quarter)."""
    plain = df.agg(F.lit("plain").alias("encoding"), F.count("*").cast("double").alias("cells"))
    runs = run_lengths(df, column, order, partition).agg(F.lit("run_length").alias("encoding"), (F.count("*") * 2.0).alias("cells"))
    words = df.agg(F.lit("dictionary").alias("encoding"), (F.count_distinct(column) + F.count("*") / 4.0).alias("cells"))
    return plain.unionByName(runs).unionByName(words).orderBy("cells", "encoding")
