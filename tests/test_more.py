"""Stage reports and cache, writer backup, flush triggers, scope shapes, score patterns, clashing names of encodings."""

import pytest
from pyspark.sql import functions as F

from deltaloom.operators import encode, scoring, urls
from deltaloom.operators import stage_graph as g
from deltaloom.sources import csv_sink
from deltaloom.streaming.streams import Flush


def test_stage_reports_and_cache(spark):
    stages = g.stages_of(spark, [("a", "A", "HIGH", 400, ["active"], []), ("b", "B", "LOW", 10, ["final"], ["a"]), ("c", "C", "LOW", 20, [], ["a"])])
    one = g.efficiency(stages).first()
    assert (one["stages"], one["sequential_seconds"], one["parallel_seconds"]) == (3, 430, 420)
    assert {r["id"] for r in g.suggestions(stages).collect()} >= {"a", "b"} and g.report(stages).count() == 3
    now = [0.0]
    cache = g.SelectionCache(ttl=10, clock=lambda: now[0])
    assert cache.plan(stages, []).order[0] == "a" and cache.plan(stages, []).status == "ok" and (cache.hits, cache.misses) == (1, 1)
    now[0] = 100
    cache.plan(stages, [])
    assert cache.misses == 2


def test_backup_and_mark(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    options = csv_sink.SinkOptions(backup=True, bom=True)
    csv_sink.write_csv(spark.createDataFrame([("1",)], "v string"), path, options)
    csv_sink.write_csv(spark.createDataFrame([("2",)], "v string"), path, options)
    assert "2" in {r["value"] for r in spark.read.text(path).collect()}
    assert csv_sink.recover(spark, path) and not csv_sink.recover(spark, path)
    # Spark's reader takes the mark off, so the bytes are looked at.
    written = [f.read_bytes() for f in (tmp_path / "out").glob("part-*")]
    assert "\ufeffv\n1\n".encode() in written and all(x.startswith("\ufeffv\n".encode()) for x in written)


def test_flush_options():
    assert Flush("buffer").source_options() and Flush("mixed").sink_options() and Flush("mixed").trigger() == {"processingTime": "5.0 seconds"} and not Flush().sink_options()


def test_scope_shapes_and_patterns(spark):
    basic = spark.createDataFrame([("https://api.example.org/x",), ("shop.org",)], "url string")
    assert {r["domain"] for r in urls.convert_any(basic).collect()} == {"api.example.org", "shop.org"}
    signals = spark.createDataFrame([("t", "http_alive", 0.5)], "target string, signal string, confidence double")
    patterns = spark.createDataFrame([("t", "api_with_no_auth"), ("t", "api_with_no_auth")], "target string, pattern string")
    w = scoring.weights(spark)
    plain, more = (scoring.scores(signals, w, patterns=p).first()["score"] for p in (None, patterns))
    assert more - plain == 12.0 and urls.class_report(basic).select(F.get_json_object("value", "$.n_urls")).first()[0] == "2"


def test_encodings_keep_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (1, 3, None), (2, 4, None)], "opens int, run int, entry int")
    runs = encode.run_lengths(df, "entry", ["run"], ["opens"])
    assert sorted(map(tuple, runs.collect()), key=str) == [(1, 1, 7, 2), (1, 2, None, 1), (2, 1, None, 1)]
    codes = encode.dictionary(df, "entry")
    assert sorted(map(tuple, encode.decode(encode.encode(df, "entry", codes), "entry", codes).select(*df.columns).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    for name in ("delta", "Delta"):
        with pytest.raises(ValueError):
            encode.differences(df.withColumn(name, df["run"]), "entry", ["run"], ["opens"])
    with pytest.raises(ValueError):
        encode.encode(df.withColumn("rest", df["run"]), "entry", codes)
