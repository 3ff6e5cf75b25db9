"""What can be told of a file before it is read: encoding, delimiter, header, rows. Only its first bytes or lines are looked at."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .csv_source import CsvOptions, read_csv

DELIMITERS = (",", ";", "\t", "|")
BOMS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))
SNIFF_LINES = 10


def _first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """Through Spark's file system, so any store that Spark reaches will do."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return b"".join(bytes([b]) for b in iter(stream.read, -1) if True) if n < 0 else bytes(b for b in (stream.read() for _ in range(n)) if b >= 0)
    finally:
        stream.close()


def detect_encoding(spark: SparkSession, path: str) -> str:
    """By the byte order mark; UTF-8 without one."""
    head = _first_bytes(spark, path, 3)
    return next((name for bom, name in BOMS if head.startswith(bom)), "UTF-8")


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that occurs most often in the first ten lines; the first of them on ties."""
    lines = spark.read.text(path).limit(SNIFF_LINES)
    counts = lines.agg(*(F.coalesce(F.sum(F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))), F.lit(0)).alias(str(i)) for i, d in enumerate(DELIMITERS))).first()
    return max(enumerate(DELIMITERS), key=lambda x: (counts[x[0]], -x[0]))[1]


def read_header(spark: SparkSession, path: str, delimiter: str = ",") -> list[str]:
    return read_csv(spark, path, CsvOptions(delimiter=delimiter)).columns


def file_size(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def estimate_rows(spark: SparkSession, path: str, sample: int = 1024) -> int:
    """Line breaks of the first bytes, carried on to the file's size."""
    head, size = _first_bytes(spark, path, sample), file_size(spark, path)
    return round(head.count(b"\n") * size / len(head)) if head else 0
