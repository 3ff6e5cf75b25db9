"""Writing tables: CSV files, CSV and JSON text, plain-text tables, statistics, retries."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import csv_escape

COMPRESSION = {"none": "none", "gzip": "gzip", "zlib": "deflate"}
SUFFIXES = {".gz": "gzip", ".gzip": "gzip", ".z": "deflate", ".zlib": "deflate"}


@dataclass(frozen=True)
class SinkOptions:
    delimiter: str = ","
    quote: str = '"'
    header: bool = True
    always_quote: bool = False
    compression: str = "auto"
    rows_per_file: int = 0
    max_cell: int = 1 << 20
    mode: str = "overwrite"
    bom: bool = False
    backup: bool = False

    def codec(self, path: str) -> str:
        """``auto`` goes by the path's suffix."""
        if self.compression == "auto":
            return next((c for s, c in SUFFIXES.items() if path.lower().endswith(s)), "none")
        return COMPRESSION[self.compression]


def write_csv(df: DataFrame, path: str, options: SinkOptions = SinkOptions()) -> dict[str, int]:
    """Write part files; rows all of whose cells are empty are skipped and counted, cells over the bound are an error.

    Returns rows written, rows skipped and characters. The figures come from the writing job itself.
    """
    if options.backup:
        _rename(df.sparkSession, path, f"{path}.bak")
    if options.bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    chars = sum((F.length(c) for c in cells), F.lit(0))
    empty = chars == 0
    long = F.greatest(*(F.length(c) for c in cells), F.lit(0)) > options.max_cell
    seen = Observation()
    watched = df.observe(seen, F.count(F.when(~empty, 1)).alias("rows"), F.count(F.when(empty, 1)).alias("skipped"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"))
    checked = watched.where(~empty).where(F.when(long, F.raise_error(F.lit("a cell is longer than the sink allows")).cast("boolean")).otherwise(F.lit(True)))
    writer = checked.write.mode(options.mode).options(sep=options.delimiter, quote=options.quote, escape=options.quote, header=str(options.header).lower(), quoteAll=str(options.always_quote).lower(), compression=options.codec(path), emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    if options.rows_per_file:
        writer = writer.option("maxRecordsPerFile", options.rows_per_file)
    writer.csv(path)
    return dict(seen.get)


def _rename(spark: SparkSession, old: str, new: str) -> bool:
    """In any store that Spark reaches; what is at the new place goes. False if there is nothing at the old one."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(a):
        return False
    fs.delete(b, True)
    return fs.rename(a, b)


def recover(spark: SparkSession, path: str) -> bool:
    """Put the backup of an earlier write back in its place; False if there is none."""
    return _rename(spark, f"{path}.bak", path)


def csv_line(cols: list[str], delimiter: str = ",", always: bool = True) -> Column:
    """One CSV line of a row's cells; quotes are doubled."""
    return F.concat_ws(delimiter, *(csv_escape(F.coalesce(F.col(c).cast("string"), F.lit("")), delimiter, always=always) for c in cols))


def json_rows(df: DataFrame) -> DataFrame:
    """A column ``value`` of one JSON object a row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def with_retries(action: Callable[[], object], attempts: int = 3, delay: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> object:
    """Run again after a failure, each time after twice the delay; the last failure is raised."""
    for k in range(attempts):
        try:
            return action()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(delay * 2**k)
    raise ValueError("attempts must be at least 1")
