"""Segment index, dyadic range join, posting lists, Bloom filters, closure, states, isolation of engines, changed columns."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import text_pairs
from deltaloom.operators import diff as d
from deltaloom.operators import joins, merge, text_index
from deltaloom.operators.closure import closure
from deltaloom.operators.engine import Engine, EngineConfig, grouped
from deltaloom.operators.segments import edit_candidates


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.25, 0.5, 0.7857, 0.9, 1.0])
def test_no_pair_within_the_distance_is_missed(spark, least):
    rnd = random.Random(int(least * 100))
    texts = ["", "a", "é"]
    for _ in range(70):
        t = "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 18)))
        texts.append(t)
        edited = list(t)
        for _ in range(rnd.randint(1, 4)):
            k = rnd.randrange(len(edited) + 1)
            edited[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "cc"])
        texts.append("".join(edited))
    rows = [(i, str(i % 2), t) for i, t in enumerate(texts)]
    got = [tuple(r) for r in edit_candidates(spark.createDataFrame(rows, "id long, block string, text string"), least).collect()]
    assert len(got) == len({*got}) and all(a < b for a, b in got)
    near = {(i, j) for i, p, a in rows for j, q, b in rows if i < j and p == q and (1 - _distance(a, b) / max(len(a), len(b), 1)) >= least - 1e-12}
    assert near <= {*got}
    assert all(p == q for a, b in got for p, q in [(rows[a][1], rows[b][1])])


def test_one_block_of_all_names_compares_few_pairs(spark):
    """Distinct customer names and segments of a whole table as one block: far fewer pairs are compared than there are."""
    c = spark.read.parquet("/root/testdata/sf0.01/customer.parquet")
    names = c.select(F.col("c_custkey").alias("id"), F.lit("all").alias("block"), F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 24).alias("text"))
    n = names.count()
    found = edit_candidates(names, 0.7857).count()
    assert n > 1000 and found < n * n / 2 / 50


def test_fuzzy_clusters_of_several_fields(spark):
    """Compared with all pairs, for thresholds with and without the index."""
    rnd = random.Random(4)
    rows = [(k, rnd.choice("xy"), rnd.choice(["smith", "smyth", "smithe", "jones", "", None]), rnd.choice(["berlin", "berlim", "paris", "", None])) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, block string, name string, city string")
    for threshold in (0.35, 0.8):
        got = {r["id"]: r["cluster"] for r in merge.fuzzy_clusters(df, "id", ["name", "city"], ["block"], threshold).collect()}
        a, b = df.alias("a"), df.alias("b")
        near = merge.mean_similarity([(F.col("a.name"), F.col("b.name")), (F.col("a.city"), F.col("b.city"))]) >= threshold
        links = [tuple(r) for r in a.join(b, "block").where(near).select("a.id", "b.id").collect()]
        want = {k: k for k, *_ in rows}
        for _ in rows:
            for x, y in links:
                want[x] = want[y] = min(want[x], want[y])
        assert got == want


def test_fuzzy_clusters_alike_by_pairs_and_by_index(spark, monkeypatch):
    """Names that all begin alike, so that an index of segments meets every pair many times: none of a small block are indexed."""
    rnd = random.Random(9)
    rows = [(k, k % 3 if k < 150 else 0, f"BRAND#{rnd.randint(1, 25)} {rnd.choice(['large', 'hot', 'small'])} {rnd.choice(['ring', 'bolt', 'gear'])}") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, block long, name string")
    want = sorted(map(tuple, merge.fuzzy_clusters(df, "id", ["name"], ["block"]).collect()))
    monkeypatch.setattr(merge, "MOST_PAIRED", 60)  # some blocks by the index, some by pairs
    assert sorted(map(tuple, merge.fuzzy_clusters(df, "id", ["name"], ["block"]).collect())) == want
    assert 3 < len({c for _, c in want}) < len({(b, n) for _, b, n in rows})
    monkeypatch.undo()
    monkeypatch.setattr(merge, "edit_candidates", None)  # not called
    assert sorted(map(tuple, merge.fuzzy_clusters(df, "id", ["name"], ["block"]).collect())) == want


@pytest.mark.parametrize("kind", ["long", "double", "timestamp"])
def test_range_join_over_any_length(spark, kind):
    rnd = random.Random(7)
    base = datetime(2024, 1, 1)
    value = {"long": lambda x: x, "double": lambda x: x / 3, "timestamp": lambda x: base + timedelta(seconds=x)}[kind]
    points = [(k, None if k % 50 == 9 else value(rnd.randint(-3000, 3000))) for k in range(400)] + [(1000 + k, value(5)) for k in range(200)]
    spans = []
    for k in range(120):
        a = rnd.randint(-3500, 3500)
        spans.append((k, value(a), value(a + rnd.choice([-1, 0, 1, 2, 7, 64, 100, 1000, 6000]))))
    spans += [(900, None, value(1)), (901, value(1), None)]
    p, s = spark.createDataFrame(points, f"id long, v {kind}"), spark.createDataFrame(spans, f"span long, low {kind}, high {kind}")
    want = sorted((i, k) for i, v in points for k, a, b in spans if None not in (v, a, b) and a <= v <= b)
    for width in (1.0, 16.0):
        assert sorted(map(tuple, joins.in_interval(p, s, "v", "low", "high", width).select("id", "span").collect())) == want
    assert joins.in_interval(p.limit(0), s, "v", "low", "high").count() == 0 == joins.in_interval(p, s.limit(0), "v", "low", "high").count()
    # A long interval is few rows, and crowded cells are dealt.
    joins.POINTS_A_TASK, kept = 10, joins.POINTS_A_TASK
    try:
        assert sorted(map(tuple, joins.in_interval(p, s, "v", "low", "high").select("id", "span").collect())) == want
    finally:
        joins.POINTS_A_TASK = kept


@pytest.mark.parametrize("kind", ["long", "double", "timestamp"])
def test_totals_over_intervals_of_any_length(spark, kind):
    """Compared with all pairs; the pairs themselves are never made."""
    rnd = random.Random(8)
    base = datetime(2024, 1, 1)
    value = {"long": lambda x: x, "double": lambda x: x / 3, "timestamp": lambda x: base + timedelta(seconds=x / 3)}[kind]
    points = [(k, None if k % 50 == 9 else value(rnd.randint(-3000, 3000)), k % 11) for k in range(600)]
    spans = [(k, value(a), value(a + rnd.choice([-1, 0, 1, 2, 3, 64, 1000, 6000]))) for k in range(200) for a in (rnd.randint(-3500, 3500),)]
    spans += [(900, None, value(1)), (901, value(1), None), spans[0]]
    p, s = spark.createDataFrame(points, f"id long, v {kind}, w long"), spark.createDataFrame(spans, f"span long, low {kind}, high {kind}")
    held = [(k, [(i, w) for i, v, w in points if None not in (v, a, b) and a <= v <= b]) for k, a, b in spans]
    want = sorted((k, len(x), min(i for i, _ in x), sum(w for _, w in x)) for k, x in held if x)
    totals = {"n": (F.count("*"), F.sum), "least": (F.min("id"), F.min), "w_all": (F.sum("w"), F.sum)}
    for width in (1.0, 16.0):
        got = joins.totals_in_interval(p, s, "v", "low", "high", totals, width).select("span", "n", "least", "w_all")
        assert sorted(map(tuple, got.collect())) == want
    assert joins.totals_in_interval(p.limit(0), s, "v", "low", "high", totals).count() == 0 == joins.totals_in_interval(p, s.limit(0), "v", "low", "high", totals).count()


def test_clicks_of_long_intervals_are_not_paired(spark, sf):
    from deltaloom.plans.registry import QUERIES

    plan = QUERIES["join_range_lengths"](spark, sf)
    pairs = plan.agg(F.sum("n")).first()[0]
    plan.collect()
    joined, todo = [], [plan._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kids = [node.executedPlan()] if node.nodeName().startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        joined += [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
        todo += kids
    assert joined and max(joined) < pairs / 2


def test_pairs_of_blocks_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "CHUNK_ROWS", 7)
    monkeypatch.setattr(joins, "PAIRS_A_TASK", 500)
    rows = [(None if k == 5 else k, None if k % 40 == 3 else k % 3 if k < 150 else 0, f"t{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "id long, block long, p string")
    pairs = joins.pairs_within(df, ["block"], "id")
    got = [tuple(r) for r in pairs.select("p.id", "q.id", "p.p", "q.p").collect()]
    want = [(a, c, x, y) for a, b, x in rows for c, d, y in rows if None not in (a, b, c, d) and b == d and a < c]
    assert sorted(got) == sorted(want)
    sizes = [r[0] for r in pairs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 5 and max(sizes) < len(want) / 3  # not a block a task
    assert joins.pairs_within(df.limit(0), ["block"], "id").count() == 0


def test_bigrams_as_numbers(spark):
    from deltaloom.functions import similarity

    words = ["", "a", "ab", "abab", "é𝄞é", "𝄞é", "hello", "yellow", "aa", "aaa"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    codes = similarity.jaccard(similarity.bigram_codes(F.col("a")), similarity.bigram_codes(F.col("b")))
    assert df.where(codes != similarity.bigram_jaccard(F.col("a"), F.col("b"))).count() == 0


def test_distances_of_all_texts_at_once(monkeypatch):
    rnd = random.Random(5)
    for most, letters in ((8, "ab"), (16, "ab𝄞"), (32, "abcé"), (64, "ab"), (65, "abc"), (150, "ab")):
        x, y = (["", "ab", letters[0] * most, *("".join(rnd.choice(letters + more) for _ in range(rnd.randint(0, most))) for _ in range(12))] for more in ("", "z"))
        want = [[_distance(a, b) for b in y] for a in x]
        assert text_pairs.distances(x, y).tolist() == want
        with monkeypatch.context() as small:
            small.setattr(text_pairs, "STEP_BYTES", 64)
            small.setattr(text_pairs, "LETTER_BYTES", 64)
            small.setattr(text_pairs, "BIGRAMS", 3)
            assert text_pairs.distances(x, y).tolist() == want
            grams = [[{t[k : k + 2] for k in range(len(t) - 1)} for t in side] for side in (x, y)]
            common, n_x, n_y = text_pairs.common_bigrams(x, y)
            assert common.tolist() == [[len(a & b) for b in grams[1]] for a in grams[0]] and [n_x.tolist(), n_y.tolist()] == [[*map(len, side)] for side in grams]
    assert text_pairs.distances(["same"], ["same"]).tolist() == [[0]]


@pytest.mark.parametrize("chunk_rows", [7, 1024])
def test_similarities_of_names_by_chunks(spark, tmp_path, monkeypatch, chunk_rows):
    """As the built-in functions give them pair by pair, which are not called for each pair any more."""
    from deltaloom.functions import similarity
    from deltaloom.plans.registry import QUERIES

    monkeypatch.setattr(joins, "CHUNK_ROWS", chunk_rows)
    rnd = random.Random(6)
    names = ["", "a", "b", None, "ab", "é𝄞é", "𝄞é", "x" * 200, "x" * 130 + "y", *(f"Customer#{rnd.randrange(10**9):09}" for _ in range(12))]
    rows = [(None if k == 5 else k * 7919 % 401 - 100, rnd.choice(names), None if k % 40 == 3 else k % 2, "s" if k % 31 else None) for k in range(150)]
    rows += [(900, "one", 0, "s"), (900, "two", 0, "s")]  # equal ids don't pair
    c = spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    c.write.parquet(f"{tmp_path}/customer.parquet")
    x, y = F.col("p.c_name"), F.col("q.c_name")
    pairs = c.alias("p").join(c.alias("q"), F.expr("p.c_nationkey = q.c_nationkey and p.c_mktsegment = q.c_mktsegment and p.c_custkey < q.c_custkey"))
    known = x.isNotNull() & y.isNotNull()
    want = pairs.select("p.c_custkey", "q.c_custkey", *(F.when(known, f(x, y)) for f in (similarity.levenshtein_similarity, similarity.bigram_jaccard, similarity.blended))).collect()
    found = QUERIES["name_similarity"](spark, str(tmp_path))
    assert "levenshtein" not in found._jdf.queryExecution().toString()

    def key(r):
        return r[0], r[1], [(v is None, v or 0.0) for v in r[2:]]

    got, want = sorted(map(key, found.collect())), sorted(map(key, want))
    assert len(got) == len(want) > 1000
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and all(m[0] == n[0] and abs(m[1] - n[1]) <= 1.01e-6 for m, n in zip(a[2], b[2], strict=True)), (a, b)
    c.limit(0).write.parquet(f"{tmp_path}/none/customer.parquet")
    assert QUERIES["name_similarity"](spark, f"{tmp_path}/none").count() == 0


def test_buckets_grow_in_number_and_not_in_size(spark):
    engine = Engine(spark)
    engine.register("numbers", spark.range(0, 20_000_000, 1, 8))  # 160 MB, of which a task sorts a tenth
    index = engine.create_index("numbers", ("id",), "hash")
    try:
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {index.name}").collect()}
        assert int(told["Num Buckets"]) >= 9
        assert engine.lookup("numbers", "id", 12_345_678).count() == 1
    finally:
        engine.drop_index("numbers", ("id",), "hash")


def test_literals_of_patterns():
    assert text_index.literals("abc") == ["abc"] and text_index.literals("^ab(cd)+e?fg") == ["ab", "cd", "fg"]
    assert text_index.literals("a[.]b\\.c") == ["a.b.c"]
    for none in ("ab|cd", "(?i)abc", "[a-z&&[^b]]abc", "\\Qabc\\E", "(abc)*", "ab("):
        assert text_index.required(none) == []
    assert len(text_index.required("x" + "".join(chr(97 + k % 26) for k in range(200)))) <= text_index.MOST_GRAMS


def test_trigram_lookup_equals_a_scan(spark, monkeypatch):
    monkeypatch.setattr(text_index, "PIECE", 7)  # texts of several pieces
    rows = [(k, t) for k, t in enumerate(["the quick fox", "quick", "qu ick", None, "", "ab", "𝄞quick𝄞é", "line\nbreak quick", "the quick fox", "x" * 50 + "quick" + "y" * 50])]
    engine = Engine(spark)
    engine.register("texts", spark.createDataFrame(rows, "id long, t string"))
    engine.create_index("texts", ("t",), "trigram")
    for pattern in ("quick", "uick", "ick f", "k𝄞é", "q.*x", "^the", "break", "xqu", "zzz", "qu", "(quick|line)", "quick$", "e\\nb"):
        got = sorted(r["id"] for r in engine.lookup_pattern("texts", "t", pattern).collect())
        assert got == sorted(r["id"] for r in engine.table("texts").where(F.col("t").rlike(pattern)).collect()), pattern
    plan = engine.lookup_pattern("texts", "t", "quick")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan
    engine.drop_index("texts", ("t",), "trigram")


def test_trigrams_of_many_rows_share_a_line(spark):
    """Lines of the index are some bits of 64 rows each, not a line a row; texts of broken UTF-8 and long ones are found, too."""
    texts = ["the quick brown fox %d" % (k % 7) for k in range(1000)] + ["é" * 10 + "𝄞needle", "", None, "x" * 3_000_000 + "needle"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string").coalesce(1)
    df = df.unionByName(spark.sql("SELECT 2000L AS id, CAST(X'FF6E6565646C65FE' AS STRING) AS t"))
    rows = df.withColumn("row_id", F.monotonically_increasing_id())
    lines = text_index.postings(rows, "row_id", "t")
    pairs = sum(len({b[k : k + 3] for k in range(len(b) - 2)}) for b in (t.encode() for t in texts if t))
    assert lines.count() < pairs / 10
    engine = Engine(spark)
    engine.register("many", df)
    engine.create_index("many", ("t",), "trigram")
    for pattern in ("needle", "𝄞need", "quick.*fox 3", "éé𝄞", "\ufffdneedle"):
        got = sorted(r["id"] for r in engine.lookup_pattern("many", "t", pattern).select("id").collect())
        assert got == sorted(r["id"] for r in df.where(F.col("t").rlike(pattern)).select("id").collect()) and got, pattern
    engine.drop_index("many", ("t",), "trigram")


def test_bloom_filters_leave_row_groups_out(spark):
    engine = Engine(spark)
    engine.register("keys", spark.range(0, 200_000, 1, 1).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("s"), "id"))
    engine.create_index("keys", ("k", "s"), "bloom", {"parquet.block.size": str(1 << 20), "parquet.enable.dictionary": "false"})
    asked = engine.table("keys").where("id = 123456").select("k", "s").first()

    def read(df):
        rows = df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return len(rows), leaf.metrics().apply("numOutputRows").value()

    for found, scanned in (read(engine.lookup("keys", "k", asked["k"])), read(engine.lookup("keys", "s", asked["s"]))):
        assert found == 1 and 0 < scanned < 60_000  # one or two row groups of a megabyte, of more than a dozen
    assert read(engine.lookup("keys", "k", 1))[0] == 0
    engine.drop_index("keys", ("k", "s"), "bloom")


@pytest.mark.parametrize("pairs", [[], [(1, 2), (2, 3), (3, 4), (2, 3)], [(1, 2), (2, 1), (3, 3), (None, 1), (1, None)], [(k, k + 1) for k in range(25)] + [(0, 20)]])
def test_closure(spark, pairs):
    want, links = {}, {p for p in pairs if None not in p}
    now, k = {p: 1 for p in links}, 1
    while now:
        want |= {p: s for p, s in now.items() if p not in want}
        k += 1
        now = {p: k for p in {(a, d) for (a, b), s in want.items() if s == k - 1 for c, d in links if b == c} if p not in want}
    got = {(r["a"], r["b"]): r["steps"] for r in closure(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()}
    assert got == want


def test_states_of_groups_of_any_size(spark):
    rows = [("hot", float(k)) for k in range(3000)] + [(None, 1.0), ("cold", 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = grouped(df, ["g"], lambda t: (float(t["v"].max()), len(t)), lambda a, b: (max(a[0], b[0]), int(a[1] + b[1])), "most double, n long")
    assert {r["g"]: (r["most"], r["n"]) for r in got.collect()} == {"hot": (2999.0, 3000), None: (3.0, 2), "cold": (2.0, 1)}


def test_engines_keep_their_tables_apart(spark):
    a, b = Engine(spark), Engine(spark)
    a.register("t", spark.range(3))
    assert a.execute("SELECT COUNT(*) AS n FROM t").cell(0, "n") == 3
    b.register("t", spark.range(7))
    assert a.execute("SELECT COUNT(*) AS n FROM t").cell(0, "n") == 3 and b.execute("SELECT COUNT(*) AS n FROM t").cell(0, "n") == 7
    assert a.execute("SELECT t.id FROM t WHERE t.id = 1").rows() == [(1,)]
    assert a.execute("WITH t AS (SELECT 42 AS x) SELECT x FROM t").cell(0, "x") == 42
    assert a.execute("WITH u AS (SELECT id FROM t) SELECT COUNT(*) AS n FROM u").cell(0, "n") == 3
    a.register("t", spark.range(4))
    assert a.execute("SELECT COUNT(*) AS n FROM t").cell(0, "n") == 4
    # Tables that aren't the engine's are read, and never from the cache.
    spark.range(1).createOrReplaceTempView("outside_t")
    assert a.execute("SELECT COUNT(*) AS n FROM outside_t").cell(0, "n") == 1
    spark.range(2).createOrReplaceTempView("outside_t")
    assert a.execute("SELECT COUNT(*) AS n FROM outside_t").cell(0, "n") == 2
    assert b.unload("t") and not spark.catalog.tableExists("t")


def test_nothing_runs_before_rows_are_asked_for(spark):
    e = Engine(spark)
    e.register("r", spark.range(10).select(F.raise_error(F.lit("computed")).alias("x")))
    r = e.execute("SELECT x FROM r")
    with pytest.raises(Exception, match="computed"):
        r.rows()


@pytest.mark.parametrize("where", ["NOT missing = 'a' AND x > 1", "NOT (missing = 'a') AND x > 1", "NOT ((NOT missing IN ('a', 'b'))) AND x > 1", "x > 1 AND NOT missing BETWEEN 1 AND 2", "x > 1 AND missing = 'a'"])
def test_skipped_conditions_under_not(spark, where):
    e = Engine(spark, EngineConfig(compat=True))
    e.register_rows("r", ["x"], [["1"], ["2"], ["3"]])
    assert e.execute(f"SELECT x FROM r WHERE {where}").column("x") == ["2", "3"]


@pytest.mark.parametrize("config", [d.DiffConfig("key_based"), d.DiffConfig("content_hash"), d.DiffConfig("field_by_field", order="id")])
def test_changed_columns_of_two_versions(spark, config):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "z")], "id long, v string, gone string")
    new = spark.createDataFrame([(1, "a", 7), (2, "b", None), (4, "d", 9)], "id long, v string, extra int")
    changes = d.diff(old, new, config)
    assert sorted(map(str, d.apply(old, changes, new).collect())) == sorted(map(str, new.collect()))
    assert d.diff(new, new.withColumn("more", F.lit(None).cast("string")), config).count() == 0  # an empty column changes nothing
    only = d.diff(old.select("id", "v"), old.select("id", "v").withColumn("extra", F.lit("e")), config)
    assert only.count() == (6 if config.mode == "content_hash" else 3)
    if config.mode == "key_based":
        by = {r["key"]: (r["op"], r["changed"]) for r in changes.collect()}
        assert by['{"id":"1"}'] == ("UPDATE", [2, 3]) and '{"id":"2"}' not in by and by['{"id":"3"}'][0] == "DELETE"
        with pytest.raises(ValueError):
            d.diff(old, new, d.DiffConfig("key_based", keys=("gone",)))


def _least_moves(old, new):
    """Matched rows less the longest increasing part, by the plain quadratic recurrence."""
    nth, places = {}, {}
    for k, v in enumerate(new):
        places[v, nth.setdefault(v, 0)] = k
        nth[v] += 1
    nth, seq = {}, []
    for v in old:
        n = nth.setdefault(v, 0)
        nth[v] += 1
        if (v, n) in places:
            seq.append(places[v, n])
    best = []
    for k, v in enumerate(seq):
        best.append(1 + max((b for b, u in zip(best, seq[:k], strict=True) if u < v), default=0))
    return len(seq) - max(best, default=0)


@pytest.mark.parametrize("seed", range(4))
def test_fewest_moves(spark, seed, monkeypatch):
    from deltaloom.operators import moves

    rnd = random.Random(seed)
    old = [rnd.choice("abcdefgh") + str(rnd.randrange(6)) for _ in range(90)]
    new = [*(f"top{k}" for k in range(5)), *old]
    for _ in range(seed * 6):
        v = new.pop(rnd.randrange(len(new)))
        new.insert(rnd.randrange(len(new)), v)
    new = [v for v in new if rnd.random() > 0.05]
    side = lambda rows: spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "pos long, v string").selectExpr("pos", "v")
    got = d.fewest_moves(side(old), side(new), "pos", "pos").collect()
    assert len(got) == _least_moves(old, new)
    assert all(old[r["row_index"]] == new[r["new_index"]] == r["old"][0] for r in got)
    # What stays is in the same order on both sides, also where ranges are thinned out by themselves.
    monkeypatch.setattr(moves, "RUNS_A_TASK", 7)
    gone = {(r["row_index"], r["new_index"]) for r in d.fewest_moves(side(old), side(new), "pos", "pos").collect()}
    nth, places, stay = {}, {}, []
    for k, v in enumerate(new):
        places[v, nth.setdefault(v, 0)] = k
        nth[v] += 1
    nth = {}
    for k, v in enumerate(old):
        n = nth.setdefault(v, 0)
        nth[v] += 1
        if (v, n) in places and (k, places[v, n]) not in gone:
            stay.append(places[v, n])
    assert stay == sorted(stay)


@pytest.mark.parametrize("seed", range(2))
def test_fewest_moves_in_blocks(spark, seed, monkeypatch):
    """More runs than one task looks at: as few moves as in one task, and the same ones."""
    from deltaloom.operators import moves

    rnd = random.Random(seed)
    old = list(range(60))
    new = old[:]
    for _ in range(25):
        new.insert(rnd.randrange(len(new)), new.pop(rnd.randrange(len(new))))
    new = [v for v in new if v % 9] + [v for v in new if v % 9 == 0]
    side = lambda rows: spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "pos long, v long").selectExpr("pos", "v")
    found = lambda: {(r["row_index"], r["new_index"]) for r in d.fewest_moves(side(old), side(new), "pos", "pos").collect()}
    whole = found()
    monkeypatch.setattr(moves, "RUNS_A_TASK", 12)
    assert found() == whole and len(whole) == _least_moves(old, new)


def test_an_insertion_at_the_top_moves_nothing(spark):
    old = spark.range(0, 500).selectExpr("id AS pos", "id % 7 AS v")
    new = spark.range(0, 501).selectExpr("id - 1 AS pos", "if(id = 0, -1, (id - 1) % 7) AS v")
    assert d.fewest_moves(old, new, "pos", "pos").count() == 0
    assert d.fewest_moves(old.limit(0), new, "pos", "pos").count() == 0
    assert d.diff(old, new, d.DiffConfig("content_hash", order="pos", detect_moves=True, fewest_moves=True)).where("op = 'MOVE'").count() == 0


def test_orders_moved_on_the_smallest_table(spark, sf):
    from deltaloom.plans.registry import QUERIES

    got = {(r["row_index"], r["new_index"]) for r in QUERIES["diff_fewest_moves"](spark, sf).collect()}
    rows = sorted((r["o_orderkey"], int(r["o_totalprice"] // 1) % 5 if r["o_orderkey"] % 3 == 0 else int(r["o_totalprice"] // 1), r["o_orderstatus"]) for r in spark.read.parquet(f"{sf}/orders.parquet").collect())
    old = [r[1:] for r in rows]
    new = [r[1:] for r in sorted([(-k, -1, s) for k, _, s in rows if k % 50 == 1] + [(k + (1 << 40) if k % 97 == 0 else k, p, s) for k, p, s in rows], key=lambda r: r[0])]
    assert len(got) == _least_moves(old, new)
