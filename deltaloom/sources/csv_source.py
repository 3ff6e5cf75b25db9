"""Reading CSV: whole tables, strings, single lines, merge sources, fixed-schema scans."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.compat import to_bool
from . import quoted_csv

SCOPE_COLUMNS = (
    "identifier", "asset_type", "instruction", "eligible_for_bounty", "eligible_for_submission", "availability_requirement",
    "confidentiality_requirement", "integrity_requirement", "max_severity", "system_tags", "created_at", "updated_at",
)


@dataclass(frozen=True)
class CsvOptions:
    """How to read a CSV file. All cells are text; an empty cell stays an empty text."""

    delimiter: str = ","
    quote: str = '"'
    header: bool = True
    trim: bool = True
    strict: bool = False
    multi_line: bool = False
    encoding: str = "UTF-8"
    columns: tuple[str, ...] = ()
    max_cell: int = 1 << 20

    def spark_options(self) -> dict[str, str]:
        return {
            "sep": self.delimiter, "quote": self.quote, "escape": self.quote, "header": str(self.header).lower(), "encoding": self.encoding,
            "ignoreLeadingWhiteSpace": str(self.trim).lower(), "ignoreTrailingWhiteSpace": str(self.trim).lower(), "multiLine": str(self.multi_line).lower(),
            "mode": "FAILFAST" if self.strict else "PERMISSIVE", "inferSchema": "false", "maxCharsPerColumn": str(self.max_cell), "enforceSchema": str(not self.header).lower(),
        }


def text_schema(columns: tuple[str, ...] | list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str | list[str], options: CsvOptions = CsvOptions()) -> DataFrame:
    """A table of text columns; cells that a short row lacks are empty, blank lines are dropped.

    Files with line breaks inside quotes need ``multi_line``: quotes are then counted first, so that files are split all the
    same (see :mod:`quoted_csv`). Only encodings other than UTF-8 are read a file a task there.
    """
    if options.multi_line and options.encoding.upper().replace("-", "") == "UTF8":
        return _read_quoted(spark, path, options)
    reader = spark.read.options(**options.spark_options())
    if options.columns:
        reader = reader.schema(text_schema(options.columns))
    return reader.csv(path).na.fill("")


def _read_quoted(spark: SparkSession, path: str | list[str], options: CsvOptions) -> DataFrame:
    given = options.spark_options()
    columns = list(options.columns) or spark.read.options(**given).csv(path).columns
    rows = quoted_csv.read_records(spark, path, options.quote).where(F.trim("record", F.lit(" \t\r\n")) != "")
    cells = quoted_csv.parsed(F.col("record"), columns, given)
    kept = rows.where("not first") if options.header else rows
    return kept.select(cells.alias("r")).select(*(F.coalesce(F.col("r")[c], F.lit("")).alias(c) for c in columns))


def parse_lines(lines: DataFrame, columns: tuple[str, ...], options: CsvOptions = CsvOptions(), line_col: str = "value") -> DataFrame:
    """Rows from a column of CSV lines (no header among them); blank lines are dropped."""
    given = {k: v for k, v in options.spark_options().items() if k in ("sep", "quote", "escape", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace", "mode")}
    cells = F.from_csv(F.col(line_col), text_schema(columns).simpleString()[7:-1].replace(":", " "), given)
    return lines.where(F.trim(line_col) != "").select(cells.alias("r")).select(*(F.coalesce(F.col("r")[c], F.lit("")).alias(c) for c in columns))


def parse_string(spark: SparkSession, text: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """A table from CSV text on the driver; line breaks inside quotes are cells' text."""
    import csv
    import io

    rows = [r for r in csv.reader(io.StringIO(text), delimiter=options.delimiter, quotechar=options.quote, strict=options.strict) if r]
    if options.trim:
        rows = [[c.strip(" \t\r\n") for c in r] for r in rows]
    if not rows:
        return spark.createDataFrame([], text_schema(options.columns))
    names, rows = (rows[0], rows[1:]) if options.header else (list(options.columns) or [f"_c{i}" for i in range(max(map(len, rows)))], rows)
    width = len(names)
    if options.strict and any(len(r) != width for r in rows):
        raise ValueError("a row doesn't have as many cells as the header")
    return spark.createDataFrame([(r + [""] * width)[:width] for r in rows], text_schema(names))


def split_line(line: Column, n_cells: int, delimiter: str = ",", quote: str = '"') -> Column:
    """The cells of one CSV line as an array, doubled quotes undone, each trimmed."""
    cells = F.from_csv(line, ", ".join(f"c{i} string" for i in range(n_cells)), {"sep": delimiter, "quote": quote, "escape": quote, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return F.array(*(F.trim(F.coalesce(cells[f"c{i}"], F.lit(""))) for i in range(n_cells)))


def parse_async(spark: SparkSession, path: str, options: CsvOptions, action, pool: ThreadPoolExecutor | None = None) -> Future:
    """Run ``action`` on the table in a thread of its own; the result is waited for on the future."""
    return (pool or ThreadPoolExecutor(1)).submit(lambda: action(read_csv(spark, path, options)))


def read_scope(spark: SparkSession, path: str) -> DataFrame:
    """Scope rows of exactly twelve cells; others are dropped. Flags become booleans, requirements stay text."""
    raw = spark.read.schema(text_schema((*SCOPE_COLUMNS, "_corrupt_record"))).options(header="true", columnNameOfCorruptRecord="_corrupt_record", mode="PERMISSIVE", quote='"', escape='"').csv(path)
    whole = raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record").na.fill("")
    return whole.withColumns({c: F.coalesce(to_bool(F.col(c), ("true", "1"), ("false", "0")), F.lit(False)) for c in ("eligible_for_bounty", "eligible_for_submission")})


def variant(c: Column) -> Column:
    """A requirement cell as integer, else double, else text."""
    return F.struct(c.try_cast("long").alias("as_int"), c.try_cast("double").alias("as_double"), c.alias("as_text"))


def parse_statistics(df: DataFrame) -> DataFrame:
    """One row: rows, cells, empty cells, and the least, most and mean text length of a row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    size, empty = sum((F.length(c) for c in cells), F.lit(0)), sum((F.when(c == "", 1).otherwise(0) for c in cells), F.lit(0))
    return df.agg(F.count("*").alias("rows"), (F.count("*") * len(cells)).alias("cells"), F.coalesce(F.sum(empty), F.lit(0)).alias("empty_cells"), F.min(size).alias("least_chars"), F.max(size).alias("most_chars"), F.avg(size).alias("mean_chars"))
