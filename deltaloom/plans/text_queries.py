"""Scalar functions, similarity, tokens, urls, scores, CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat, hashing, strings, text_pairs
from ..operators import joins, scoring, urls
from ..operators.engine import inverted_index
from ..operators.staging import shared_dir
from ..sources import contracts, csv_sink, csv_source
from .registry import query, table


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_round_trip(spark, sf):
    """Write CSV, read it again: all text, nothing lost."""
    path = _folder(spark, "nation-csv")
    csv_sink.write_csv(table(spark, sf, "nation"), path)
    return csv_source.read_csv(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand || ', \"' || p_type || '\"' AS odd FROM part")
def csv_quoted_gzip(spark, sf):
    """Delimiters and quotes inside cells, every cell quoted, compressed."""
    path = _folder(spark, "part-csv")
    odd = F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"'))
    csv_sink.write_csv(table(spark, sf, "part").select("p_partkey", "p_name", odd.alias("odd")), path, csv_sink.SinkOptions(delimiter=";", always_quote=True, compression="gzip"))
    return csv_source.read_csv(spark, path, csv_source.CsvOptions(delimiter=";"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS text, coalesce(lang, '') AS kind FROM documents UNION ALL SELECT CAST(page_id AS VARCHAR), coalesce(html, ''), 'page' FROM pages")
def csv_quoted_breaks(spark, sf):
    """Whole texts and raw pages through CSV: line breaks and quotes inside cells, files still read in splits."""
    path = _folder(spark, "texts-csv")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("kind"))
    both = docs.union(table(spark, sf, "pages").select("page_id", "html", F.lit("page")))
    csv_sink.write_csv(both, path, csv_sink.SinkOptions(max_cell=1 << 30))
    return csv_source.read_csv(spark, path, csv_source.CsvOptions(multi_line=True, trim=False, max_cell=-1))


@query("SELECT r_regionkey, '\"' || r_regionkey || '\",\"' || r_name || '\"' AS line FROM region")
def csv_lines(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", csv_sink.csv_line(["r_regionkey", "r_name"]).alias("line"))


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def json_lines(spark, sf):
    return csv_sink.json_rows(table(spark, sf, "region"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def parse_csv_lines(spark, sf):
    """Lines in a column, parsed where they are."""
    lines = table(spark, sf, "customer").select(csv_sink.csv_line(["c_custkey", "c_name", "c_mktsegment"], always=False).alias("value"))
    return csv_source.parse_lines(lines, ("id", "name", "segment"))


@query("SELECT count(*) AS rows, count(*) * 3 AS cells, 0::BIGINT AS empty_cells, min(n) AS least_chars, max(n) AS most_chars, round(avg(n), 4) AS mean_chars FROM (SELECT length(CAST(n_nationkey AS VARCHAR)) + length(n_name) + length(CAST(n_regionkey AS VARCHAR)) AS n FROM nation)")
def parse_statistics(spark, sf):
    s = csv_source.parse_statistics(table(spark, sf, "nation"))
    return s.withColumns({"mean_chars": F.round("mean_chars", 4), "empty_cells": F.col("empty_cells").cast("long"), "least_chars": F.col("least_chars").cast("long"), "most_chars": F.col("most_chars").cast("long")})


@query("SELECT '1.0' AS schema_ver, '' AS program, url, '' AS title, CAST(page_id AS VARCHAR) AS timestamp FROM pages")
def contract_columns(spark, sf):
    """A table brought to a file contract."""
    pages = table(spark, sf, "pages").select(F.lit("1.0").alias("schema_ver"), "url", F.col("page_id").alias("timestamp"))
    return contracts.conform(pages, "02_probe").select("schema_ver", "program", "url", "title", "timestamp")


@query(r"""SELECT page_id, lower(trim(url)) AS low, string_split(url, '/') [3] AS host, length(url) AS n, array_to_string(string_split(url, '/'), '|') AS joined FROM pages""")
def string_functions(spark, sf):
    parts = strings.split_text(F.col("url"), "/")
    return table(spark, sf, "pages").select("page_id", strings.lower_trim(F.col("url")).alias("low"), F.get(parts, F.lit(2)).alias("host"), F.length("url").cast("long").alias("n"), strings.join_text(parts, "|").alias("joined"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '% %' THEN p_name ELSE p_name END AS cell, contains(p_name, ',') OR contains(p_name, '\"') AS odd FROM part")
def csv_escaping(spark, sf):
    c = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", strings.csv_escape(c).alias("cell"), strings.needs_quoting(c).alias("odd"))


@query(r"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents) GROUP BY token""")
def token_counts_standard(spark, sf):
    each = table(spark, sf, "documents").select(F.explode(strings.tokens(F.col("text"))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> ''))::BIGINT AS n FROM documents""")
def token_counts_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(strings.tokens(F.col("text"), "whitespace", lower=False)).cast("long").alias("n"))


@query(r"""SELECT token, count(*) AS n_docs, sum(n)::BIGINT AS n FROM (SELECT token, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents) GROUP BY 1, 2) GROUP BY token""")
def fulltext_index(spark, sf):
    index = inverted_index(table(spark, sf, "documents"), "doc_id", "text")
    return index.groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


_PAIRS = "SELECT a.c_custkey AS a, b.c_custkey AS b, a.c_name AS x, b.c_name AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 1)), lambda i: substr({0}, i, 2)))"
_JACCARD = f"len(list_intersect({_GRAMS.format('x')}, {_GRAMS.format('y')})) / len(list_distinct(list_concat({_GRAMS.format('x')}, {_GRAMS.format('y')})))"


@query(f"""SELECT a, b, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS edit, round({_JACCARD}, 6) AS grams,
round(CASE WHEN x = y THEN 1 ELSE 0.7 * (1 - levenshtein(x, y) / greatest(length(x), length(y))) + 0.3 * {_JACCARD} END, 6) AS blend FROM ({_PAIRS})""")
def name_similarity(spark, sf):
    """All pairs of a block, whose number grows with the square of its rows; similarities are made for all names of two chunks at once."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", F.col("c_name").cast("binary").alias("c_name"))
    chunks = joins.chunks_within(c, ["c_nationkey", "c_mktsegment"], "c_custkey")
    return text_pairs.of_chunks(chunks, "c_custkey", "c_name")


@query("SELECT o_orderkey, md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS md5, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS sha FROM orders")
def row_hashes(spark, sf):
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    return table(spark, sf, "orders").select("o_orderkey", hashing.row_md5(cols).alias("md5"), hashing.row_sha256(cols).alias("sha"))


_CELLS = "(SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'NULL' WHEN 1 THEN '' WHEN 2 THEN '007' WHEN 3 THEN '200abc' WHEN 4 THEN '2024-01-15' WHEN 5 THEN '-3.5' WHEN 6 THEN 'TRUE' WHEN 7 THEN '10.0.0.1' ELSE CAST(event_id AS VARCHAR) END AS cell FROM events)"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty cells made from the event number."""
    k = F.col("event_id") % 9
    words = ("NULL", "", "007", "200abc", "2024-01-15", "-3.5", "TRUE", "10.0.0.1")
    chain = F.when(k == 0, words[0])
    for i, w in enumerate(words[1:], 1):
        chain = chain.when(k == i, w)
    return table(spark, sf, "events").select("event_id", chain.otherwise(F.col("event_id").cast("string")).alias("cell"))


@query(f"""SELECT event_id, TRY_CAST(CASE WHEN regexp_full_match(cell, '-?[0-9]*[.]?[0-9]*') AND regexp_matches(cell, '[0-9]') THEN cell END AS DOUBLE) AS number,
CASE WHEN cell IN ('NULL', 'null') THEN NULL ELSE cell END AS text, CASE WHEN lower(cell) IN ('true', '1', 'yes', 'y', 'on') THEN true WHEN lower(cell) IN ('false', '0', 'no', 'n', 'off') THEN false END AS flag FROM {_CELLS}""")
def compat_coercion(spark, sf):
    c = F.col("cell")
    return _cells(spark, sf).select("event_id", compat.number(c).alias("number"), compat.null_text(c).alias("text"), compat.to_bool(c).alias("flag"))


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN cell = '' THEN 'STRING' WHEN regexp_full_match(cell, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CASE WHEN contains(cell, '.') THEN 'FLOAT' ELSE 'INTEGER' END
WHEN lower(cell) IN ('true', 'false', 'yes', 'no') THEN 'BOOLEAN' WHEN regexp_full_match(cell, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'DATE' ELSE 'STRING' END AS kind FROM {_CELLS}) GROUP BY kind""")
def detect_types(spark, sf):
    return _cells(spark, sf).groupBy(compat.detect_type(F.col("cell")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""SELECT count(*) FILTER (WHERE try_cast(cell AS DOUBLE) > 5 AND regexp_full_match(cell, '-?[0-9]*[.]?[0-9]*')) + count(*) FILTER (WHERE NOT (regexp_full_match(cell, '-?[0-9]*[.]?[0-9]*') AND regexp_matches(cell, '[0-9]')) AND cell <> 'NULL' AND cell > '5') AS n FROM {_CELLS}""")
def compat_compare(spark, sf):
    """Numbers by value, text by bytes, NULL never."""
    return _cells(spark, sf).agg(F.count_if(compat.compare(F.col("cell"), ">", F.lit("5"))).alias("n"))


@query(f"""SELECT format('{{:.6f}}', sum(CASE WHEN regexp_full_match(cell, '-?[0-9]*[.]?[0-9]*') AND regexp_matches(cell, '[0-9]') THEN cell::DOUBLE END)) AS total, min(cell) AS lo, max(cell) AS hi FROM {_CELLS}""")
def compat_aggregates(spark, sf):
    c = F.col("cell")
    return _cells(spark, sf).agg(compat.sum_text(c).alias("total"), compat.min_text(c).alias("lo"), compat.max_text(c).alias("hi"))


@query("SELECT DISTINCT url FROM pages WHERE regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '[.](png|jpg|jpeg|gif|ico|css|woff|woff2|ttf|svg|mp4|mp3|avi|zip|tar|gz|pdf|doc|docx)([?]|$)')")
def kept_urls(spark, sf):
    return urls.kept_urls(table(spark, sf, "pages"))


@query("""SELECT count(url) AS n_urls, count(*) FILTER (WHERE regexp_matches(url, '(?i)(api|v[0-9]|rest|graphql|json|xml)')) AS n_api,
count(*) FILTER (WHERE regexp_matches(url, '(?i)(admin|dashboard|panel|login|auth|config|setup|install|debug|test)')) AS n_sensitive, count(*) FILTER (WHERE regexp_matches(url, '[.]js([?]|$)')) AS n_js,
count(*) FILTER (WHERE regexp_matches(url, '[?].*=') AND regexp_matches(url, '(?i)(id|user|token|key|secret|password|admin|debug|test|dev)')) AS n_params,
count(*) FILTER (WHERE regexp_matches(url, '[.](php|asp|aspx|jsp|do|action|cgi|pl)([?]|$)')) AS n_dynamic FROM pages""")
def url_class_counts(spark, sf):
    return urls.class_counts(table(spark, sf, "pages"))


@query("SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS name FROM pages WHERE regexp_matches(url, '^https?://[^/?#]+')")
def valid_host_names(spark, sf):
    hosts = table(spark, sf, "pages").select(F.lower(urls.host_of(F.col("url"))).alias("name"))
    return urls.valid_names([hosts, hosts])


@query("""WITH h AS (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS domain, min(url) AS identifier FROM pages GROUP BY 1)
SELECT domain, identifier, CASE WHEN contains(domain, 'api') THEN 1 WHEN contains(domain, 'admin') OR contains(domain, 'auth') OR starts_with(domain, 'login.') THEN 0 ELSE 1 END AS sub, 1 AS api,
CASE WHEN contains(domain, 'api') OR contains(domain, 'admin') OR contains(domain, 'auth') OR starts_with(domain, 'login.') OR contains(domain, 'dev') OR contains(domain, 'staging') THEN 0 WHEN contains(domain, 'shop') OR starts_with(domain, 'store.') THEN 1 ELSE 0 END AS mobile,
CASE WHEN contains(domain, 'api') THEN 5 WHEN contains(domain, 'admin') THEN 3 WHEN contains(domain, 'auth') OR starts_with(domain, 'login.') THEN 2 WHEN contains(domain, 'dev') OR contains(domain, 'staging') THEN 15 WHEN contains(domain, 'shop') OR starts_with(domain, 'store.') THEN 8 ELSE 10 END AS rps,
CASE WHEN contains(domain, 'api') THEN 'API endpoint' WHEN contains(domain, 'admin') THEN 'Admin interface' WHEN contains(domain, 'auth') OR starts_with(domain, 'login.') THEN 'Authentication system' WHEN contains(domain, 'dev') OR contains(domain, 'staging') THEN 'Development/Staging environment' WHEN contains(domain, 'shop') OR starts_with(domain, 'store.') THEN 'E-commerce platform' ELSE 'Main domain' END AS note FROM h""")
def scope_conversion(spark, sf):
    return urls.convert_scope(table(spark, sf, "pages").select(F.col("url").alias("identifier"), F.lit("URL").alias("asset_type")))


@query("SELECT page_id, substr(md5(url), 1, 8) || '_' || regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g') AS file FROM pages")
def script_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", hashing.script_name(F.col("url")).alias("file"))


_SIGNALS = {"click": "http_alive", "view": "http_redirect", "purchase": "tech_admin_panel", "error": "api_openapi_spec", "signup": "js_secret_key"}


@query("""WITH w(event_type, weight) AS (VALUES ('click', 5.0::DOUBLE), ('view', 1.0), ('purchase', 8.0), ('error', 7.0), ('signup', 9.0)),
s AS (SELECT user_id AS target, count(*) AS n_signals, avg((event_id % 10) / 10.0::DOUBLE) AS c, sum(coalesce(weight, 0) * ((event_id % 10) / 10.0::DOUBLE)) AS raw FROM events LEFT JOIN w USING (event_type) GROUP BY 1),
b AS (SELECT *, CASE WHEN c >= 0.7 THEN raw * 1.2 ELSE raw END AS boosted FROM s),
f AS (SELECT *, round(greatest(0, least(100, CASE WHEN boosted > 70 THEN boosted * 1.3 ELSE boosted END)), 2) AS score FROM b)
SELECT target, n_signals, round(c, 4) AS confidence, score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'info' END AS severity FROM f""")
def risk_scores(spark, sf):
    """Events as signals with a confidence from their number."""
    names = F.create_map(*(F.lit(x) for pair in _SIGNALS.items() for x in pair))
    signals = table(spark, sf, "events").select(F.col("user_id").alias("target"), F.try_element_at(names, F.col("event_type")).alias("signal"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))
    return scoring.scores(signals, scoring.weights(spark))
