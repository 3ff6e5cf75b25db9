"""Hashes of rows and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_text(cols: list[str | Column], empty: str = "") -> Column:
    """Cells as text, a bar between them; null as empty. A form to show: rows that differ in bars or nulls can look alike."""
    return F.concat_ws("|", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(empty)) for c in cols))


def row_sha256(cols: list[str | Column]) -> Column:
    return F.sha2(row_text(cols), 256)


def content_sha256(cols: list[str | Column]) -> Column:
    """Equal for equal rows only: cells are kept apart, and null from empty."""
    cells = [(F.col(c) if isinstance(c, str) else c).cast("string").alias(f"c{k}") for k, c in enumerate(cols)]
    return F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256)


def row_md5(cols: list[str | Column]) -> Column:
    return F.md5(row_text(cols))


def row_hash64(cols: list[str]) -> Column:
    return F.xxhash64(*cols)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def script_name(url: Column) -> Column:
    """Eight digits of the url's MD5 and its base name with odd characters replaced."""
    base = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)
    return F.concat(F.substring(F.md5(url), 1, 8), F.lit("_"), F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_"))
