"""Versioned schemas, checks of headers and rows, error tables and reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import EMPTY_WORDS, FALSE_WORDS, TRUE_WORDS
from .staging import fresh

KINDS = ("STRING", "INTEGER", "FLOAT", "BOOLEAN", "DATE", "DATETIME", "EMAIL", "URL", "IP", "UUID", "ENUM", "CUSTOM")

# Shapes of the checked types, full match.
DATE = r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(/.*)?$"
IPV4, IPV6 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", r"^[0-9a-fA-F:]{2,39}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

ERROR_FIELDS = "severity string, field string, position int, message string, actual string, expected string"
ERROR_TYPE = f"array<struct<{ERROR_FIELDS.replace(' ', ':').replace(',:', ',')}>>"


@dataclass
class Field:
    """A column: its type and constraints. ``check`` (for CUSTOM) maps a column to a boolean column."""

    name: str
    kind: str = "STRING"
    required: bool = True
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    values: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    default: str | None = None
    description: str = ""
    check: Callable[[Column], Column] | None = None


@dataclass
class Schema:
    name: str
    version: str
    fields: list[Field]
    strict: bool = True
    allow_extra: bool = False
    description: str = ""

    def faults(self) -> list[str]:
        names = [f.name for f in self.fields]
        out = [] if self.name else ["the schema has no name"]
        out += [] if self.fields else ["the schema has no fields"]
        out += [f"field {n} occurs twice" for n in sorted({n for n in names if names.count(n) > 1})]
        return out + [f"field {f.name} has no type {f.kind}" for f in self.fields if f.kind not in KINDS]

    def to_json(self) -> str:
        return json.dumps({**asdict(self), "fields": [{k: v for k, v in asdict(f).items() if k != "check"} for f in self.fields]}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Schema:
        tree = json.loads(text)
        fields = [Field(**{**f, "values": tuple(f["values"]), "aliases": tuple(f["aliases"])}) for f in tree.pop("fields")]
        return Schema(fields=fields, **tree)

    def document(self) -> str:
        lines = [f"# {self.name} {self.version}", "", self.description, "", "| field | type | required | limits |", "|---|---|---|---|"]
        for f in self.fields:
            limits = ", ".join(x for x in (f"from {f.low:g}" if f.low is not None else "", f"to {f.high:g}" if f.high is not None else "", f"matches {f.pattern}" if f.pattern else "", "one of " + " ".join(f.values) if f.values else "") if x)
            lines.append(f"| {f.name} | {f.kind} | {'yes' if f.required else 'no'} | {limits} |")
        return "\n".join(lines)


#: Named checks for CUSTOM fields.
NAMED: dict[str, Callable[[Column], Column]] = {
    "non_empty": lambda c: F.trim(c) != "",
    "alphanumeric": lambda c: c.rlike(r"^[A-Za-z0-9]+$"),
    "numeric": lambda c: c.rlike(r"^[+-]?\d+(\.\d+)?$"),
}


def trimmed(c: Column) -> Column:
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(" \t\n\r"))


def is_empty(v: Column) -> Column:
    return v.isin(*EMPTY_WORDS)


def _error(v: Column, bad: Column, severity: str, field: str, position: int, message: str, expected: str) -> Column:
    """An array of the error, or an empty one: arrays are joined in compiled code, which a filter over one array isn't."""
    error = F.array(F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), F.lit(position).alias("position"), F.lit(message).alias("message"), v.alias("actual"), F.lit(expected).alias("expected")))
    return F.when(bad, error).otherwise(F.array().cast(ERROR_TYPE))


def _number_checks(f: Field, kind: str) -> list[tuple[Callable[[Column], Column], str, str]]:
    shape = r"^[+-]?\d+$" if kind == "long" else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    value = lambda v: v.try_cast(kind)
    out = [(lambda v: ~v.rlike(shape) | value(v).isNull(), f"not {'an integer' if kind == 'long' else 'a number'}", f.kind)]
    if f.low is not None:
        out.append((lambda v: F.coalesce(value(v) < f.low, F.lit(False)), "too small", f"at least {f.low:g}"))
    if f.high is not None:
        out.append((lambda v: F.coalesce(value(v) > f.high, F.lit(False)), "too large", f"at most {f.high:g}"))
    return out


def _octets(v: Column) -> Column:
    return reduce(Column.__and__, (F.regexp_extract(v, IPV4, i).try_cast("int") <= 255 for i in range(1, 5)))


def checks(f: Field) -> list[tuple[Callable[[Column], Column], str, str]]:
    """What can be wrong with a filled cell: (column -> boolean, message, what was expected)."""
    shape = lambda p: lambda v: ~v.rlike(p)
    if f.kind == "STRING":
        out = []
        if f.low is not None:
            out.append((lambda v: F.octet_length(v) < int(f.low), "too short", f"at least {f.low:g} bytes"))
        if f.high is not None:
            out.append((lambda v: F.octet_length(v) > int(f.high), "too long", f"at most {f.high:g} bytes"))
        if f.pattern:
            out.append((shape(f"^(?:{f.pattern})$"), "doesn't match", f.pattern))
        return out
    if f.kind in ("INTEGER", "FLOAT"):
        return _number_checks(f, "long" if f.kind == "INTEGER" else "double")
    if f.kind == "CUSTOM":
        return [(lambda v: ~f.check(v), "fails its check", "custom")] if f.check else []
    return {
        "BOOLEAN": lambda: [(lambda v: ~F.lower(v).isin(*TRUE_WORDS, *FALSE_WORDS), "not a boolean", "BOOLEAN")],
        "DATE": lambda: [(lambda v: ~v.rlike(DATE) | F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNull(), "not a date", "YYYY-MM-DD")],
        "DATETIME": lambda: [(shape(DATETIME), "not a date and time", "ISO 8601")],
        "EMAIL": lambda: [(shape(EMAIL), "not an address", "EMAIL")],
        "URL": lambda: [(shape(URL), "not a url", "URL")],
        "IP": lambda: [(lambda v: ~((v.rlike(IPV4) & F.coalesce(_octets(v), F.lit(False))) | v.rlike(IPV6)), "not an IP address", "IP")],
        "UUID": lambda: [(shape(UUID), "not a UUID", "UUID")],
        "ENUM": lambda: [(lambda v: ~v.isin(*f.values), "not an allowed value", ", ".join(f.values))],
    }[f.kind]()


def _column(df: DataFrame, f: Field) -> str | None:
    return next((c for c in (f.name, *f.aliases) if c in df.columns), None)


def header_errors(columns: list[str], schema: Schema) -> list[dict]:
    """Missing required fields are errors; unknown columns are warnings, and errors where the schema is strict and allows none."""
    known = {n for f in schema.fields for n in (f.name, *f.aliases)}
    out = [{"severity": "ERROR", "field": f.name, "message": "column is missing"} for f in schema.fields if f.required and not {f.name, *f.aliases} & {*columns}]
    severity = "ERROR" if schema.strict and not schema.allow_extra else "WARNING"
    return out + [{"severity": severity, "field": c, "message": "column is unknown"} for c in columns if c not in known]


def _faults(df: DataFrame, schema: Schema) -> tuple[list[Column], list[tuple[Column, tuple]]]:
    """The trimmed cells, as ``v0, v1, ...``, and every check over them: what is wrong, and (severity, field, position, message, expected)."""
    values, found = [], []
    for k, f in enumerate(schema.fields):
        name = _column(df, f)
        values.append(trimmed(F.col(f"`{name}`")).alias(f"v{k}") if name else F.lit("").alias(f"v{k}"))
        each = [(lambda v: is_empty(v), "required value is missing", "a value")] if f.required and f.default is None else []
        each += [(lambda v, bad=bad: ~is_empty(v) & bad(v), message, expected) for bad, message, expected in checks(f)]
        found += [(lambda of, bad=bad, k=k: F.coalesce(bad(of(k)), F.lit(True)), ("ERROR", f.name, k, message, expected)) for bad, message, expected in each]
    return values, found


def _coded(df: DataFrame, schema: Schema, cells: str, code: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """A row for each error with its number ``code``, and what a number stands for: errors are small numbers until they are few."""
    values, found = _faults(df, schema)
    of = lambda k: F.col(f"{cells}.v{k}")
    rows = df.withColumn(cells, F.struct(*values)) if found else df.where("false").withColumn(cells, F.struct(F.lit("").alias("v0")))
    numbers = [F.when(bad(of), F.lit(n)) for n, (bad, _) in enumerate(found)] or [F.lit(None).cast("int")]
    out = rows.withColumn(code, F.explode(F.array(*numbers))).where(F.col(code).isNotNull())
    parts = ("severity", "field", "position", "message", "expected")

    def part(name: str) -> Column:
        if name == "actual":
            return F.get(F.array(*(of(k) for k in range(max(1, len(values))))), part("position"))
        told = [t[parts.index(name)] for _, t in found]
        return F.get(F.array(*map(F.lit, told)) if told else F.array().cast("array<int>" if name == "position" else "array<string>"), F.col(code))

    return out, part


def with_errors(df: DataFrame, schema: Schema, into: str = "errors") -> DataFrame:
    """``df`` with the array ``into``, empty for a valid row. A missing column counts as empty cells.

    Cells are trimmed and tested for emptiness once, in a projection of their own.
    """
    cells = fresh([*df.columns, into], "cells")
    values, checked = _faults(df, schema)
    if not checked:
        return df.withColumn(into, F.array().cast(ERROR_TYPE))
    of = lambda k: F.col(f"{cells}.v{k}")
    found = [_error(of(k), bad(of), severity, field, k, message, expected) for bad, (severity, field, k, message, expected) in checked]
    return df.withColumn(cells, F.struct(*values)).withColumn(into, F.concat(*found)).drop(cells)


def valid_rows(df: DataFrame, schema: Schema) -> DataFrame:
    into = fresh(df.columns, "errors")
    return with_errors(df, schema, into).where(F.size(into) == 0).drop(into)


def error_rows(df: DataFrame, schema: Schema, id_cols: list[str], severity: str | None = None, most_per_field: int | None = None) -> DataFrame:
    """A row for each error with the row's id columns; a cap keeps the first of each field by the ids.

    The cap is met in each partition first, so no task sorts all errors of a field.
    """
    cells, code = fresh(df.columns, "cells"), fresh(df.columns, "code")
    out, part = _coded(df, schema, cells, code)
    out = out.select(*id_cols, *(part(c).alias(c) for c in ("severity", "field", "position", "message", "actual", "expected")))
    if severity:
        out = out.where(F.col("severity") == severity)
    if most_per_field:
        part, nth = fresh(out.columns, "part"), fresh(out.columns, "nth")
        for by in (["field", part], ["field"]):
            ranked = out.withColumn(part, F.spark_partition_id()) if part in by else out
            out = ranked.withColumn(nth, F.row_number().over(Window.partitionBy(*by).orderBy(*id_cols, "message"))).where(F.col(nth) <= most_per_field).drop(nth, part)
    return out


def first_error(df: DataFrame, schema: Schema, id_cols: list[str]) -> DataFrame:
    """At most one row: where validation would stop."""
    return error_rows(df, schema, id_cols).orderBy(*id_cols, "position").limit(1)


def summary(df: DataFrame, schema: Schema) -> DataFrame:
    """One row: rows, valid rows, errors, success percent."""
    cells, n = fresh(df.columns, "cells"), fresh(df.columns, "n")
    values, found = _faults(df, schema)
    of = lambda k: F.col(f"{cells}.v{k}")
    counted = reduce(Column.__add__, (F.when(bad(of), 1).otherwise(0) for bad, _ in found), F.lit(0))
    rows = df.withColumn(cells, F.struct(*values) if values else F.lit(None)).select(counted.alias(n))
    out = rows.agg(F.count("*").alias("rows"), F.count_if(F.col(n) == 0).alias("valid_rows"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("errors"))
    return out.withColumn("success_percent", F.when(F.col("rows") > 0, 100.0 * F.col("valid_rows") / F.col("rows")).otherwise(100.0))


def report(df: DataFrame, schema: Schema) -> DataFrame:
    """``field, message, n`` over all errors."""
    cells, code = fresh(df.columns, "cells"), fresh(df.columns, "code")
    out, part = _coded(df, schema, cells, code)
    # Numbers are counted before they are given their names.
    return out.groupBy(code).agg(F.count("*").alias("n")).select(part("field").alias("field"), part("message").alias("message"), "n").groupBy("field", "message").agg(F.sum("n").alias("n"))


def _version(text: str) -> tuple[int, int, int]:
    a, b, c = (int(x) for x in text.split("."))
    return a, b, c


def compatible(have: str, want: str) -> bool:
    """Same major version, minor at least the wanted one."""
    h, w = _version(have), _version(want)
    return h[0] == w[0] and h[1] >= w[1]


@dataclass
class Registry:
    """Schemas by name and version."""

    schemas: dict[str, dict[str, Schema]] = field(default_factory=dict)

    def add(self, schema: Schema) -> None:
        if faults := schema.faults():
            raise ValueError("; ".join(faults))
        self.schemas.setdefault(schema.name, {})[schema.version] = schema

    def get(self, name: str, version: str | None = None) -> Schema | None:
        """The version itself, else the latest compatible one; without a version the latest."""
        known = self.schemas.get(name, {})
        if version in known:
            return known[version]
        fits = [v for v in known if version is None or compatible(v, version)]
        return known[max(fits, key=_version)] if fits else None

    def can_migrate(self, name: str, start: str, end: str) -> bool:
        known = self.schemas.get(name, {})
        return start in known and end in known and _version(start)[0] == _version(end)[0] and _version(start) <= _version(end)

    def migrate(self, df: DataFrame, name: str, start: str, end: str) -> DataFrame:
        """The columns of the later version; new ones take their default or nothing."""
        if not self.can_migrate(name, start, end):
            raise ValueError(f"{name} can't go from {start} to {end}")
        target = self.schemas[name][end]
        return df.select(*((F.col(_column(df, f)) if _column(df, f) else F.lit(f.default)).cast("string").alias(f.name) for f in target.fields))


# The built-in schemas, version 1.0.0.
BUILTIN: dict[str, list[Field]] = {
    "scope": [
        Field("domain", "STRING", low=1, high=253),
        Field("program", "STRING", low=1, high=100),
        Field("status", "ENUM", values=("active", "inactive", "paused")),
        Field("notes", "STRING", required=False, high=500),
    ],
    "subdomains": [
        Field("subdomain", "STRING", low=1, high=253),
        Field("source", "STRING", low=1, high=50),
        Field("wildcard", "BOOLEAN", required=False),
        Field("discovered_at", "DATE"),
    ],
    "probe": [
        Field("url", "URL"),
        Field("status_code", "INTEGER", low=100, high=599),
        Field("content_length", "INTEGER", required=False, low=0),
        Field("title", "STRING", required=False, high=200),
        Field("technologies", "STRING", required=False, high=500),
    ],
    "headless": [
        Field("url", "URL"),
        Field("js_frameworks", "STRING", required=False, high=200),
        Field("forms", "STRING", required=False, high=1000),
        Field("xhr_endpoints", "STRING", required=False, high=2000),
        Field("spa_detected", "BOOLEAN", required=False),
    ],
    "discovery": [
        Field("url", "URL"),
        Field("status_code", "INTEGER", low=100, high=599),
        Field("content_length", "INTEGER", required=False, low=0),
        Field("content_type", "STRING", required=False, high=100),
        Field("discovery_type", "ENUM", values=("directory", "file", "backup", "config", "source")),
    ],
    "jsintel": [
        Field("js_url", "URL"),
        Field("endpoints", "STRING", required=False, high=2000),
        Field("api_keys", "STRING", required=False, high=1000),
        Field("secrets", "STRING", required=False, high=500),
        Field("comments", "STRING", required=False, high=1000),
    ],
    "api_catalog": [
        Field("api_endpoint", "URL"),
        Field("api_type", "ENUM", values=("REST", "GraphQL", "SOAP", "gRPC")),
        Field("methods", "STRING", low=1, high=100),
        Field("parameters", "STRING", required=False, high=2000),
        Field("authentication_required", "BOOLEAN", required=False),
    ],
    "api_findings": [
        Field("api_endpoint", "URL"),
        Field("vulnerability_type", "ENUM", values=("IDOR", "SQLi", "XSS", "Auth_Bypass", "Rate_Limit")),
        Field("severity", "ENUM", values=("Low", "Medium", "High", "Critical")),
        Field("description", "STRING", low=1, high=1000),
        Field("proof_of_concept", "STRING", required=False, high=2000),
    ],
    "mobile_intel": [
        Field("app_package", "STRING", low=1, high=200),
        Field("platform", "ENUM", values=("Android", "iOS")),
        Field("endpoints", "STRING", required=False, high=2000),
        Field("certificates", "STRING", required=False, high=1000),
        Field("deep_links", "STRING", required=False, high=1000),
    ],
    "changes": [
        Field("url", "URL"),
        Field("change_type", "ENUM", values=("content", "certificate", "dns", "headers", "technology")),
        Field("previous_value", "STRING", required=False, high=1000),
        Field("current_value", "STRING", required=False, high=1000),
        Field("detected_at", "DATE"),
    ],
    "final_ranked": [
        Field("target", "URL"),
        Field("finding_type", "ENUM", values=("vulnerability", "information", "technology", "endpoint")),
        Field("severity", "ENUM", values=("Info", "Low", "Medium", "High", "Critical")),
        Field("risk_score", "FLOAT", low=0, high=10),
        Field("description", "STRING", low=1, high=1000),
        Field("source_module", "STRING", low=1, high=50),
    ],
}


def builtin() -> Registry:
    registry = Registry()
    for name, fields in BUILTIN.items():
        registry.add(Schema(name, "1.0.0", [replace(f) for f in fields]))
    return registry
