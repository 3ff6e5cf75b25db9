"""CSV, settings, validation, stage graphs, scopes, streams, functions."""

import gzip

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import compat, hashing, similarity, strings
from deltaloom.operators import scoring, stage_graph, urls
from deltaloom.operators import validate as v
from deltaloom.plans.stream_queries import STAGES
from deltaloom.sources import contracts, csv_sink, csv_source, settings, sniff
from deltaloom.streaming import streams

COMPLEX = 'name,description,value\n"Smith, J","said ""hi""",1.5\nB,"two\nlines",2\nC,,3\n'


def test_csv_reading(spark, tmp_path):
    (tmp_path / "c.csv").write_text(COMPLEX)
    want = [("Smith, J", 'said "hi"', "1.5"), ("B", "two\nlines", "2"), ("C", "", "3")]
    assert [tuple(r) for r in csv_source.read_csv(spark, f"{tmp_path}/c.csv", csv_source.CsvOptions(multi_line=True)).collect()] == want
    assert [tuple(r) for r in csv_source.parse_string(spark, COMPLEX).collect()] == want
    (tmp_path / "r.csv").write_text("a;b;c\n1;2\n\n 3 ;4;5\n")
    assert [tuple(r) for r in csv_source.read_csv(spark, f"{tmp_path}/r.csv", csv_source.CsvOptions(delimiter=";")).collect()] == [("1", "2", ""), ("3", "4", "5")]
    with pytest.raises(ValueError):
        csv_source.parse_string(spark, "a,b\n1\n", csv_source.CsvOptions(strict=True))
    line = spark.createDataFrame([('a,"b ""q"" ",  c ',)], "l string").select(csv_source.split_line(F.col("l"), 3).alias("x")).first()["x"]
    assert line == ["a", 'b "q"', "c"]
    assert csv_source.parse_async(spark, f"{tmp_path}/r.csv", csv_source.CsvOptions(delimiter=";"), lambda df: df.count()).result() == 2


def test_large_file_keeps_all_rows(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,name\n" + "".join(f'{i},"n ""{i}"", x"\n' for i in range(20_000)))
    df = csv_source.read_csv(spark, f"{tmp_path}/big.csv")
    assert df.count() == 20_000 and df.where("name = concat('n \"', id, '\", x')").count() == 20_000


def test_sniffing(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfa;b\n1;2\n")
    (tmp_path / "b.csv").write_bytes(b"\xff\xfea\x00")
    (tmp_path / "c.csv").write_text("x|y,z\n1|2\n3|4\n")
    assert sniff.detect_encoding(spark, f"{tmp_path}/a.csv") == "UTF-8" and sniff.detect_encoding(spark, f"{tmp_path}/b.csv") == "UTF-16LE"
    assert sniff.detect_delimiter(spark, f"{tmp_path}/a.csv") == ";" and sniff.detect_delimiter(spark, f"{tmp_path}/c.csv") == "|"
    assert sniff.read_header(spark, f"{tmp_path}/a.csv", ";") == ["a", "b"]
    assert sniff.estimate_rows(spark, f"{tmp_path}/c.csv") == 3 and sniff.file_size(spark, f"{tmp_path}/c.csv") == 14


def test_scope_scan(spark, tmp_path):
    head = ",".join(csv_source.SCOPE_COLUMNS)
    (tmp_path / "s.csv").write_text(f"{head}\nhttps://a.example.org,URL,,true,1,high,2,0.5,critical,,t,t\nshort,URL\n")
    got = csv_source.read_scope(spark, f"{tmp_path}/s.csv").collect()
    assert len(got) == 1 and got[0]["eligible_for_bounty"] is True and got[0]["max_severity"] == "critical"


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"q'), (" lead", "x\ny"), ("", ""), ("", "z")], "x string, y string").coalesce(1)
    figures = csv_sink.write_csv(df, f"{tmp_path}/out.gz")
    assert figures["rows"] == 3 and figures["skipped"] == 1
    part = next(p for p in (tmp_path / "out.gz").iterdir() if p.name.endswith(".csv.gz"))
    assert gzip.open(part, "rt").readline() == "x,y\n"
    back = csv_source.read_csv(spark, f"{tmp_path}/out.gz", csv_source.CsvOptions(multi_line=True, trim=False))
    assert sorted(map(tuple, back.collect())) == [("", "z"), (" lead", "x\ny"), ("a,b", 'q"q')]
    with pytest.raises(Exception, match="longer"):
        csv_sink.write_csv(df, f"{tmp_path}/o2", csv_sink.SinkOptions(max_cell=2))
    tries = []
    waits = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert csv_sink.with_retries(flaky, sleep=waits.append) == "done" and waits == [0.1, 0.2]


def test_contracts(spark):
    assert {k: len(c) for k, c in contracts.CONTRACTS.items()} == {"01_subdomains": 19, "02_probe": 28, "03_headless": 25, "04_discovery": 33, "05_jsintel": 26, "06_api_catalog": 27, "07_api_findings": 28, "08_mobile_intel": 31, "09_changes": 30, "99_final_ranked": 36}
    assert contracts.empty(spark, "02_probe").columns[-1] == "timestamp"


def test_settings():
    text = "a:\n  b: 1 # note\n  c: true\n  list:\n    - x\n    - 2\nd: '${HOME_X}/y'\ne: [1, two]\n"
    got = settings.layered(settings.parse_yaml(text, {"HOME_X": "/h"}), settings.from_environment("APP", {"APP_A__B": "5"}), settings.from_command_line(["--set", "a.c=false"]))
    assert got == {"a.b": 5, "a.c": False, "a.list": ["x", 2], "d": "/h/y", "e": [1, "two"]}
    rules = {"a.b": settings.Rule(int, 0, 4), "a.c": settings.Rule(bool), "z": settings.Rule(str, required=True), "d": settings.Rule(str, allowed=("x",))}
    assert settings.check(got, rules) == ["a.b is out of range", "z is missing", "d isn't an allowed value"]


def test_validation_types(spark):
    cases = {
        "INTEGER": (["1", "-5", "+7"], ["12abc", "1.5", "99999999999999999999"]), "FLOAT": (["1", "1.5", "-2e3"], ["NaN", "1x", "Infinity"]), "BOOLEAN": (["YES", "off", "1"], ["maybe"]),
        "DATE": (["2024-02-29"], ["2023-02-29", "01/02/2024"]), "DATETIME": (["2024-01-01T00:00:00.5+02:00"], ["2024-01-01 00:00:00"]), "EMAIL": (["a.b@c.io"], ["a@b", "@c.io"]),
        "URL": (["http://a.io", "https://a.b.io/x?y"], ["ftp://a.io", "http://a.io:8080", "http://localhost"]), "IP": (["1.2.3.4", "::1"], ["1.2.3.256", "x.y"]),
        "UUID": (["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]), "ENUM": (["a"], ["A", "c"]), "CUSTOM": (["abc"], ["a-c"]), "STRING": (["ab"], ["a", "abcdef", "a1"]),
    }
    for kind, (good, bad) in cases.items():
        f = v.Field("x", kind, values=("a", "b"), check=v.NAMED["alphanumeric"], **({"low": 2, "high": 4, "pattern": "[a-z]+"} if kind == "STRING" else {}))
        rows = spark.createDataFrame([(c,) for c in good + bad], "x string").coalesce(1)
        assert [r["n"] == 0 for r in v.with_errors(rows, v.Schema("s", "1.0.0", [f])).select(F.size("errors").alias("n")).collect()] == [True] * len(good) + [False] * len(bad), kind


def test_validation_report_and_registry(spark):
    schema = v.Schema("people", "1.0.0", [v.Field("name"), v.Field("email", "EMAIL"), v.Field("age", "INTEGER", low=0, aliases=("years",)), v.Field("note", required=False)])
    good = spark.createDataFrame([("A", "a@b.io", "3"), ("B", "b@b.io", " 4 ")], "name string, email string, years string")
    bad = spark.createDataFrame([("", "x", "1"), ("N/A", "a@b.io", "-1")], "name string, email string, age string")
    assert v.summary(good, schema).first().asDict() == {"rows": 2, "valid_rows": 2, "errors": 0, "success_percent": 100.0}
    assert v.summary(bad, schema).first()["valid_rows"] == 0 and v.report(bad, schema).count() == 3
    assert v.error_rows(bad, schema, ["email"], most_per_field=1).where("field = 'name'").count() == 1 and v.first_error(bad, schema, ["email"]).count() == 1
    assert v.valid_rows(good, schema).count() == 2
    assert [x["severity"] for x in v.header_errors(["name", "email", "extra"], schema)] == ["ERROR", "ERROR"]
    reg = v.builtin()
    assert len(reg.schemas) == 11 and reg.get("probe").fields[1].high == 599
    assert v.Schema.from_json(schema.to_json()).to_json() == schema.to_json() and "| email | EMAIL | yes |" in schema.document()
    reg.add(v.Schema("probe", "1.2.0", [v.Field("url", "URL"), v.Field("new", default="d")]))
    assert reg.get("probe", "1.1.0").version == "1.2.0" and reg.get("probe", "2.0.0") is None and reg.get("probe", "1.0.0").version == "1.0.0"
    assert reg.migrate(spark.createDataFrame([("http://a.io",)], "url string"), "probe", "1.0.0", "1.2.0").first()["new"] == "d"
    assert v.Schema("", "1.0.0", [v.Field("a"), v.Field("a", "ODD")]).faults()


def test_stage_graph(spark):
    s = stage_graph.stages_of(spark, STAGES)
    assert {r["id"] for r in stage_graph.dependencies(s, "s5").collect()} == {"s1", "s2", "s3", "s4"}
    assert {r["id"] for r in stage_graph.dependents(s, "s3", transitive=False).collect()} == {"s5", "s6"}
    assert [r["id"] for r in stage_graph.execution_order(s).collect()] == ["s1", "s7", "s2", "s3", "s4", "s5", "s6"]
    path, seconds = stage_graph.critical_path(s)
    assert path == ["s1", "s2", "s3", "s5", "s6"] and seconds == 4200
    assert stage_graph.parallelism(s).first()["parallelism"] == pytest.approx(1.4) and stage_graph.estimates(s).first()["sequential_seconds"] == 5700
    assert stage_graph.cycles(s) == [] and {r["id"] for r in stage_graph.bottlenecks(s).collect()} == {"s1", "s3", "s4", "s5", "s6", "s7"}
    looped = stage_graph.stages_of(spark, [("a", "a", "LOW", 1, [], ["b"]), ("b", "b", "LOW", 1, [], ["a"]), ("c", "c", "LOW", 1, [], ["b"]), ("d", "d", "LOW", 1, [], ["gone"])])
    assert stage_graph.cycles(looped) == ["a -> b -> a"] and stage_graph.levels(looped).count() == 0
    chosen = stage_graph.plan(s, [stage_graph.Filter("id", "s4")])
    assert chosen.status == "ok" and chosen.order == ["s1", "s2", "s4"] and stage_graph.Selection.from_json(chosen.to_json()) == chosen
    assert stage_graph.plan(looped, [stage_graph.Filter("id", "c")]).status == "cycle" and stage_graph.plan(looped, [stage_graph.Filter("id", "d")]).status == "missing"
    assert stage_graph.plan(s, [stage_graph.Filter("name_regex", "^zzz")]).status == "empty"
    ran = []
    stage_graph.run(s, {r[0]: (lambda i=r[0]: ran.append(i)) for r in STAGES})
    assert ran.index("s1") < ran.index("s2") < ran.index("s5") < ran.index("s6") and len(ran) == 7


def test_scope_and_urls(spark):
    rows = [("https://API.example.org/x", "URL"), ("admin.example.org", "URL"), ("shop.example.org", "url"), ("com.app", "ANDROID"), ("https://api.example.org", "URL")]
    got = {r["domain"]: r for r in urls.convert_scope(spark.createDataFrame(rows, "identifier string, asset_type string")).collect()}
    assert set(got) == {"api.example.org", "admin.example.org", "shop.example.org"} and got["api.example.org"]["rps"] == 5 and got["shop.example.org"]["mobile"] == 1
    names = [spark.createDataFrame([("a.example.org",), ("bad_name",), ("x.io",)], "name string")] * 2
    assert urls.valid_names(names).count() == 2 and urls.scope_format(["identifier", "asset_type"]) == "assets"
    one = spark.createDataFrame([("https://x.io/api/v1/a.js?id=1",), ("http://x.io/a.png",)], "url string")
    assert urls.class_counts(one).first().asDict() == {"n_urls": 2, "n_api": 1, "n_sensitive": 0, "n_js": 1, "n_params": 1, "n_dynamic": 0} and urls.kept_urls(one, limit=5).count() == 1


def test_scores(spark):
    assert len(scoring.WEIGHTS) == 64
    signals = spark.createDataFrame([("t", "api_idor_potential", 0.9, "admin")] * 12 + [("u", "waf_detected", 1.0, "www"), ("u", "unknown", 1.0, "www")], "target string, signal string, confidence double, place string")
    got = {r["target"]: r for r in scoring.ranked(scoring.scores(signals, scoring.weights(spark), multiplier=scoring.factor(F.col("place"), scoring.SUBDOMAINS))).collect()}
    assert got["t"]["score"] == 100.0 and got["t"]["severity"] == "critical" and got["u"]["score"] == 0.0 and got["u"]["severity"] == "info"
    n = scoring.normalised(spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double"), "x")
    assert sorted(r["normalised"] for r in n.collect()) == [0.0, 0.5, 1.0]


def test_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    assert val(F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    assert val(similarity.bigram_jaccard(F.lit("hello"), F.lit("hallo"))) == pytest.approx(1 / 3)
    assert val(similarity.blended(F.lit(""), F.lit("a"))) == 0 and val(similarity.bigram_jaccard(F.lit("a"), F.lit("b"))) == 1
    assert val(similarity.row_similarity([(F.lit(1), F.lit(1)), (F.lit(1), F.lit(2))])) == 0.5
    assert val(strings.trim_space(F.lit("\t\x0b a b \r\n"))) == "a b" and val(strings.tokens(F.lit("Ab_1, c-D"))) == ["ab_1", "c", "d"]
    assert strings.escape_sql("a'b\n") == "a\\'b\\n" and strings.format_bytes(1_500_000) == "1MB" and strings.format_count(1234567) == "1,234,567" and strings.format_duration(1.5) == "1.500000s"
    assert strings.is_identifier("a_1") and not strings.is_identifier("1a") and not strings.is_regex("(") and not strings.is_file_name("a:b")
    assert val(compat.render(F.lit(1.5), "double")) == "1.500000" and val(compat.render(F.lit(None), "string")) == "NULL"
    cells = spark.createDataFrame([("10",), ("9",), ("abc",), ("-2",), (None,)], "c string")
    assert [r["c"] for r in cells.orderBy(*compat.sort_keys(F.col("c"))).collect()][:4] == ["-2", "9", "10", "abc"]
    assert cells.where("c rlike '^-?[0-9]+$'").agg(compat.max_text(F.col("c")).alias("m")).first()["m"] == "10"
    types = spark.createDataFrame([("1", "1.5", "2024-01-01", "x"), ("2", "3", "2024-01-02", "1")], "a string, b string, c string, d string")
    assert {r["column"]: r["type"] for r in compat.column_types(types).collect()} == {"a": "INTEGER", "b": "FLOAT", "c": "DATE", "d": "STRING"}


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc")
    assert hashing.file_hashes(spark, f"{tmp_path}/f.bin").first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = csv_source.text_schema(["id", "v"])
    write = lambda name, rows: (folder / name).write_text("id,v\n" + "".join(f"{a},{b}\n" for a, b in rows))
    write("a.csv", [(1, "x"), (2, "")])
    go = lambda: streams.write_stream(streams.csv_stream(spark, str(folder), schema), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    go()
    write("b.csv", [(3, "z")])
    go()  # a restart takes only what is new
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [("1", "x"), ("2", ""), ("3", "z")]


def test_stream_dedup_and_bucket(spark, sf, tmp_path):
    events = streams.parquet_stream(spark, f"{sf}/events.parquet")
    once = streams.drained(streams.distinct_events(events.select("user_id", "ts"), ["user_id"], "ts", "400 days"), "distinct")
    assert once.count() == spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    bucket = streams.Bucket(rate=1 / 3600, burst=3)
    live = streams.drained(streams.admit_stream(events, "user_id", "ts", bucket, "event_id"), "bucket")
    still = streams.admit_batch(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", bucket, "event_id")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, still.collect()))


def test_stream_of_changes(spark, tmp_path):
    from deltaloom.operators import diff

    spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, v string").write.parquet(f"{tmp_path}/base")
    spark.createDataFrame([("1", "A"), ("2", "b"), ("4", "d")], "id string, v string").write.parquet(f"{tmp_path}/new")
    streams.write_changes(streams.parquet_stream(spark, f"{tmp_path}/new"), f"{tmp_path}/base", ("id",), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    _, changes = diff.read_delta(spark, f"{tmp_path}/out/0")
    assert sorted(r["op"] for r in changes.collect()) == ["INSERT", "UPDATE"]


def test_recovery():
    from deltaloom.operators.recovery import Backoff, Breaker, retry

    now, tries, waits = [0.0], [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 7

    assert retry(flaky, Backoff(jitter=0), sleep=waits.append) == 7 and waits == [0.1, 0.2]
    with pytest.raises(OSError):
        tries.clear()
        retry(flaky, worth=lambda e: False)
    b = Breaker(failures=2, rest=5, clock=lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(lambda: 1 / 0)
    with pytest.raises(RuntimeError):
        b.call(lambda: 1)
    now[0] = 6
    assert b.state == "half_open" and b.call(lambda: 1) == 1 and b.state == "closed"


def test_bucket_backs_off():
    b = streams.Bucket(rate=1, first_delay=2, growth=3, most_delay=5)
    state, ok = b.step((b.capacity, 0.0, 0.0), 1.0, failed=True)
    assert ok and state[2] == 2
    state, ok = b.step(state, 2.0, failed=True)
    assert not ok and state[2] == 5
    state, _ = b.step(state, 9.0)
    assert state[2] == 2.5
    assert b.step(state, 12.0)[0][2] == 0.0
