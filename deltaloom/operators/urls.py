"""Flows over lists of names and urls: validation, filters, classes, scope conversion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name shape, dropped extensions, and the five url classes.
NAME = r"^[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}$"
STATIC = r"\.(png|jpg|jpeg|gif|ico|css|woff|woff2|ttf|svg|mp4|mp3|avi|zip|tar|gz|pdf|doc|docx)(\?|$)"
API = r"(?i)(api|v[0-9]|rest|graphql|json|xml)"
SENSITIVE = r"(?i)(admin|dashboard|panel|login|auth|config|setup|install|debug|test)"
SCRIPT = r"\.js(\?|$)"
PARAMS = r"(?i)(id|user|token|key|secret|password|admin|debug|test|dev)"
DYNAMIC = r"\.(php|asp|aspx|jsp|do|action|cgi|pl)(\?|$)"


def valid_names(lists: list[DataFrame], column: str = "name") -> DataFrame:
    """Union of name lists, valid ones only, each once."""
    return reduce(DataFrame.union, (d.select(column) for d in lists)).where(F.col(column).rlike(NAME)).distinct()


def is_kept(url: Column) -> Column:
    """http or https, and not a static file."""
    return url.rlike("^https?://") & ~url.rlike(STATIC)


def kept_urls(df: DataFrame, column: str = "url", limit: int | None = None) -> DataFrame:
    out = df.where(is_kept(F.col(column))).select(column).distinct()
    return out.orderBy(column).limit(limit) if limit else out


def classes(url: Column) -> dict[str, Column]:
    """Overlapping flags."""
    return {
        "is_api": url.rlike(API), "is_sensitive": url.rlike(SENSITIVE), "is_js": url.rlike(SCRIPT),
        "is_params": url.rlike(r"\?.*=") & url.rlike(PARAMS), "is_dynamic": url.rlike(DYNAMIC),
    }


def class_counts(df: DataFrame, column: str = "url") -> DataFrame:
    """One row: number of urls and of each class."""
    return df.agg(F.count(column).alias("n_urls"), *(F.count_if(c).alias("n_" + name[3:]) for name, c in classes(F.col(column)).items()))


def class_report(df: DataFrame, column: str = "url") -> DataFrame:
    """The counts as one line of JSON, in column ``value``."""
    return class_counts(df, column).select(F.to_json(F.struct("*")).alias("value"))


def host_of(identifier: Column) -> Column:
    """The authority of an http(s) url, else the identifier itself if it looks like a name."""
    authority = F.regexp_extract(identifier, r"^https?://([^/?#]+)", 1)
    return F.when(authority != "", authority).when(identifier.rlike(r"^[a-zA-Z0-9-]+\.[a-zA-Z]{2,}"), identifier)


# What a host's name says of it; the first that matches wins. (contains, prefix, sub, api, mobile, rps, note)
HOST_CLASSES = (
    ("api", None, 1, 1, 0, 5, "API endpoint"),
    ("admin", None, 0, 1, 0, 3, "Admin interface"),
    ("auth", "login.", 0, 1, 0, 2, "Authentication system"),
    ("dev", None, 1, 1, 0, 15, "Development/Staging environment"),
    ("staging", None, 1, 1, 0, 15, "Development/Staging environment"),
    ("shop", "store.", 1, 1, 1, 8, "E-commerce platform"),
)
HOST_DEFAULT = (1, 1, 0, 10, "Main domain")


def host_class(host: Column) -> Column:
    """Struct of sub, api, mobile, rps, note."""

    def struct(values):
        return F.struct(*(F.lit(v).alias(n) for n, v in zip(("sub", "api", "mobile", "rps", "note"), values, strict=True)))

    chain = None
    for part, prefix, *values in HOST_CLASSES:
        hit = host.contains(part) | (host.startswith(prefix) if prefix else F.lit(False))
        chain = F.when(hit, struct(values)) if chain is None else chain.when(hit, struct(values))
    return chain.otherwise(struct(HOST_DEFAULT))


def convert_scope(scope: DataFrame) -> DataFrame:
    """Url assets as ``domain`` and its class, each domain once: of several identifiers the least counts."""
    hosts = scope.where(F.upper("asset_type") == "URL").select(F.lower(host_of(F.col("identifier"))).alias("domain"), "identifier").where(F.col("domain").isNotNull())
    one = hosts.groupBy("domain").agg(F.min("identifier").alias("identifier"))
    return one.withColumn("c", host_class(F.col("domain"))).select("domain", "identifier", "c.*")


def scope_summary(converted: DataFrame) -> DataFrame:
    return converted.agg(F.count("*").alias("domains"), F.count_if(F.col("sub") == 1).alias("with_subdomains"), F.count_if(F.col("mobile") == 1).alias("with_mobile"), F.sum("rps").alias("rps"))


def scope_format(columns: list[str]) -> str:
    """Which of the known shapes a header has."""
    names = {c.strip().lower() for c in columns}
    if {"identifier", "asset_type"} <= names:
        return "assets"
    return "domains" if "domain" in names else "basic" if "url" in names else "generic"


def convert_any(scope: DataFrame) -> DataFrame:
    """Scope in any of the known shapes: url assets, domains, urls (basic), or else the first column (generic), as :func:`convert_scope` returns it."""
    kind = scope_format(scope.columns)
    if kind == "assets":
        return convert_scope(scope)
    wanted = {"domains": "domain", "basic": "url"}.get(kind)
    name = next((c for c in scope.columns if c.strip().lower() == wanted), scope.columns[0])
    return convert_scope(scope.select(F.trim(F.col(f"`{name}`")).alias("identifier"), F.lit("URL").alias("asset_type")))
