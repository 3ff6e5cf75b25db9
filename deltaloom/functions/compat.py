"""Text columns that behave like the loosely typed cells of a CSV engine.

Opt-in: typed columns and ANSI semantics are the default everywhere else. Cells are numbers only as a whole, so dates
and addresses stay text; order over mixed text is total: numbers first, by value, then text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are null, empty, true or false.
NULL_WORDS = ("NULL", "null")
EMPTY_WORDS = ("", "NULL", "null", "N/A")
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y", "on"), ("false", "0", "no", "n", "off")


def is_number(c: Column) -> Column:
    """Optional minus, digits, at most one point, at least one digit."""
    return F.coalesce(c.rlike(r"^-?[0-9]*\.?[0-9]*$") & c.rlike("[0-9]"), F.lit(False))


def number(c: Column) -> Column:
    return F.when(is_number(c), c.try_cast("double"))


def null_text(c: Column) -> Column:
    """The words NULL and null become null; an empty cell stays."""
    return F.when(~c.isin(*NULL_WORDS), c)


def compare(a: Column, op: str, b: Column) -> Column:
    """Numbers by value, else text by bytes; false where a side is null."""
    how = {
        "=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y,
        "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
    }[op]
    a, b = null_text(a), null_text(b)
    return F.coalesce(F.when(is_number(a) & is_number(b), how(number(a), number(b))).otherwise(how(a, b)), F.lit(False))


def sort_keys(c: Column, ascending: bool = True) -> list[Column]:
    keys = [F.when(is_number(c), 0).otherwise(1), number(c), c]
    return [k.asc_nulls_last() if ascending else k.desc_nulls_first() for k in keys]


def min_text(c: Column) -> Column:
    """The least number if all cells are numbers, else the least text."""
    return F.when(F.bool_and(is_number(c)), F.min(F.struct(number(c).alias("n"), c.alias("t")))["t"]).otherwise(F.min(c))


def max_text(c: Column) -> Column:
    return F.when(F.bool_and(is_number(c)), F.max(F.struct(number(c).alias("n"), c.alias("t")))["t"]).otherwise(F.max(c))


def sum_text(c: Column) -> Column:
    """Sum of the cells that are numbers, with six decimals."""
    return F.format_string("%.6f", F.coalesce(F.sum(number(c)), F.lit(0.0)))


def avg_text(c: Column) -> Column:
    """Mean of the cells that are numbers; 0 if there are none."""
    return F.coalesce(F.format_string("%.6f", F.avg(number(c))), F.lit("0"))


def render(c: Column, kind: str) -> Column:
    """Text of a typed value: doubles with six decimals, words for booleans, NULL for null."""
    text = F.format_string("%.6f", c) if kind in ("double", "float") else c.cast("string")
    return F.when(c.isNull(), F.lit("NULL")).otherwise(text)


def to_bool(c: Column, true_words: tuple[str, ...] = TRUE_WORDS, false_words: tuple[str, ...] = FALSE_WORDS) -> Column:
    word = F.lower(c)
    return F.when(word.isin(*true_words), F.lit(True)).when(word.isin(*false_words), F.lit(False))


def typed(c: Column, kind: str) -> Column:
    """The whole cell as ``int``, ``long``, ``float``, ``double``, ``bool`` or ``string``; null if it isn't one."""
    return to_bool(c) if kind == "bool" else c if kind == "string" else c.try_cast(kind)


#: Shapes of the type detector, full match.
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATES = (r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$")
TIMESTAMPS = (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?$", r"^\d{10}$")


def _any(c: Column, shapes: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (c.rlike(s) for s in shapes))


def is_numeric(c: Column) -> Column:
    return c.rlike(NUMERIC)


def is_date(c: Column) -> Column:
    return _any(c, DATES)


def is_timestamp(c: Column) -> Column:
    return _any(c, TIMESTAMPS)


def detect_type(c: Column) -> Column:
    """STRING, INTEGER, FLOAT, BOOLEAN, TIMESTAMP or DATE of a cell; numbers are tested first."""
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "STRING")
        .when(is_numeric(c), F.when(c.contains("."), "FLOAT").otherwise("INTEGER"))
        .when(F.lower(c).isin("true", "false", "yes", "no"), "BOOLEAN")
        .when(is_timestamp(c), "TIMESTAMP").when(is_date(c), "DATE").otherwise("STRING")
    )


def column_types(df: DataFrame) -> DataFrame:
    """``column, type``: the one type of all filled cells, FLOAT for integers among floats, else STRING; one pass."""
    text = {c: F.col(c).cast("string") for c in df.columns}
    seen = df.agg(*(F.collect_set(F.when(F.coalesce(t, F.lit("")) != "", detect_type(t))).alias(c) for c, t in text.items()))
    each = seen.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.sort_array(F.col(c)).alias("types")) for c in df.columns))).alias("x")).select("x.*")
    kind = F.when(F.size("types") == 1, F.col("types")[0]).when(F.col("types") == F.array(F.lit("FLOAT"), F.lit("INTEGER")), "FLOAT").otherwise("STRING")
    return each.select("column", kind.alias("type"))
