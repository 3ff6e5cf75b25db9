"""String, token and formatting functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[ \t\n\r\f\x0B]+"


def trim_space(c: Column) -> Column:
    """All six white-space characters off both ends."""
    return F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


def lower_trim(c: Column) -> Column:
    return F.lower(trim_space(c))


def split_text(c: Column, delimiter: str) -> Column:
    """Parts between a plain delimiter; trailing empty parts stay."""
    return F.split(c, re.sub(r"([^A-Za-z0-9 ])", r"\\\1", delimiter), -1)


def join_text(c: Column, delimiter: str) -> Column:
    return F.array_join(c, delimiter)


def needs_quoting(c: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """A cell with the delimiter, a quote, a line break, or a space at either end."""
    return c.contains(delimiter) | c.contains(quote) | c.contains("\n") | c.contains("\r") | c.startswith(" ") | c.endswith(" ")


def csv_escape(c: Column, delimiter: str = ",", quote: str = '"', always: bool = False, quote_empty: bool = False) -> Column:
    quoted = F.concat(F.lit(quote), F.replace(c, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
    wanted = F.lit(True) if always else needs_quoting(c, delimiter, quote) | ((c == "") & F.lit(quote_empty))
    return F.when(wanted, quoted).otherwise(c)


def is_quoted(c: Column, quote: str = '"') -> Column:
    return (F.length(c) >= 2) & c.startswith(quote) & c.endswith(quote)


def tokens(c: Column, kind: str = "standard", lower: bool = True) -> Column:
    """``standard``: runs of A-Z, a-z, 0-9 and underscore; ``whitespace``: runs without white space."""
    text = F.lower(c) if lower else c
    if kind == "standard":
        return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    if kind == "whitespace":
        return F.filter(F.split(text, _SPACE), lambda t: t != "")
    raise ValueError(f"no tokenizer {kind!r}")


def is_stage_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_.-]{1,255}$")


# The rest works on the driver's own strings.


def is_identifier(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) is not None


def is_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def escape_sql(text: str) -> str:
    """A string literal's inside: backslash before quotes and backslashes, letters for control characters."""
    return "".join({"\\": "\\\\", "'": "\\'", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c) for c in text)


def format_duration(seconds: float) -> str:
    return f"{seconds:.6f}s"


def format_bytes(n: int) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n}{unit}"
        n //= 1024
    return f"{n}TB"


def format_count(n: int) -> str:
    return f"{n:,}"


def is_file_name(name: str) -> bool:
    return bool(name) and not re.search(r'[<>:"|?*]', name)
