"""Merging, comparing, encoding."""

import random

import pytest
import pandas as pd
from pyspark.sql import functions as F

from deltaloom.operators import diff as d
from deltaloom.operators import encode as e
from deltaloom.operators import merge as m
from deltaloom.operators.clusters import clusters


def frame(spark, cols, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split(","))).coalesce(1)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_priority_and_newest(spark):
    a = frame(spark, "id,name,timestamp", [("1", "High", "2024-01-01")])
    b = frame(spark, "id,name,timestamp", [("1", "Low", "2024-01-02")])
    s = [m.Source("a", a, 2, "timestamp"), m.Source("b", b, 1, "timestamp")]
    assert got(m.merge(s, m.MergeConfig(strategy="priority")))[0][1] == "High"
    assert got(m.merge(s, m.MergeConfig(resolve="newest")))[0][1] == "Low"
    assert got(m.merge(s, m.MergeConfig(resolve="oldest")))[0][1] == "High"
    assert got(m.merge(s, m.MergeConfig(resolve="last"), source_column="src"))[0][3] == "b"


def test_schema_union_and_strictness(spark):
    a, b = frame(spark, "id,name,email", [("1", "A", "a@x")]), frame(spark, "id,name,phone", [("2", "B", "5")])
    s = [m.Source("a", a), m.Source("b", b)]
    out = m.merge(s, m.MergeConfig(strategy="schema"))
    assert sorted(out.columns) == ["email", "id", "name", "phone"] and out.count() == 2
    with pytest.raises(ValueError):
        m.merge(s)
    assert m.schema_conflicts(s) == [("email", "missing", ["b"]), ("phone", "missing", ["a"])]
    assert m.merged_columns(s) == ["id", "name", "email", "phone"]


def test_exact_hash_custom_and_idempotence(spark):
    a, b = frame(spark, "id,v", [("1", "x"), ("2", "y"), ("2", "y")]), frame(spark, "id,v", [("1", "x"), ("3", "z"), ("", "w"), ("", "w")])
    s = [m.Source("a", a), m.Source("b", b)]
    for how in ("exact", "hash"):
        once = m.merge(s, m.MergeConfig(dedup=how, resolve="first"))
        assert got(once) == [("", "w"), ("1", "x"), ("2", "y"), ("3", "z")]
        assert got(m.merge([m.Source("o", once)], m.MergeConfig(dedup=how, resolve="first"))) == got(once)
    assert len(got(m.merge(s, m.MergeConfig(resolve="first")))) == 5  # rows without a key stay
    same = lambda x, y: F.lower(f"{x}.v") == F.lower(f"{y}.v")
    assert got(m.merge(s, m.MergeConfig(dedup="custom", same=same, resolve="first")))[-1] == ("3", "z")
    longest = lambda rows: rows.sort_values("v").head(1)[["id", "v", "_source", "_priority", "_ord", "_row", "_ts"]]
    assert len(got(m.merge(s, m.MergeConfig(resolve="custom", resolver=longest)))) == 5  # rows without a key have no group


def test_many_groups_are_resolved_in_one_call(spark):
    rows = [(str(k % 40) if k % 9 else "", f"{k:03}") for k in range(400)] + [("7", f"x{k}") for k in range(300)]
    s = [m.Source("a", frame(spark, "id,v", rows[:350])), m.Source("b", frame(spark, "id,v", rows[350:]))]
    first = lambda group: group.sort_values("v").head(1)
    of_many = lambda rows, key: rows.sort_values([key, "v"]).drop_duplicates(key)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)  # groups lie over batches
    try:
        assert got(m.merge(s, m.MergeConfig(resolve="custom", resolve_many=of_many))) == got(m.merge(s, m.MergeConfig(resolve="custom", resolver=first)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = ["a"] * 5 + ["b"] + ["c"] * 9 + ["d"]
    for size in (1, 2, 4, 30):
        frames = [pd.DataFrame({"k": keys[n : n + size]}) for n in range(0, len(keys), size)]
        whole = [list(f["k"]) for f in m.whole_groups(iter([frames[0].iloc[:0], *frames]), "k")]
        assert sum(whole, []) == keys and all(a[-1] != b[0] for a, b in zip(whole, whole[1:], strict=False))


def test_filters_renames_preview_and_statistics(spark):
    a = frame(spark, "key,v", [("1", "keep"), ("2", "drop me"), ("3", "keep")])
    s = m.Source("a", a, renames={"key": "id"}, exclude={"v": "^drop"}, row_filter=F.col("id") != "3")
    assert got(m.merge([s])) == [("1", "keep")]
    assert m.preview([s], m.MergeConfig(), 5).count() == 1
    assert m.merge_statistics(a, m.merge([s])).first()["removed_share"] == pytest.approx(2 / 3)


def test_keys_that_sound_alike(spark):
    a = frame(spark, "name", [("Robert",), ("Rupert",), ("Anna",)])
    assert got(m.merge([m.Source("a", a)], m.MergeConfig(keys=("name",), phonetic=True, resolve="first"))) == [("Anna",), ("Robert",)]


def test_faults():
    assert len(m.MergeConfig(strategy="x", dedup="y", resolve="z", threshold=2).faults()) == 4
    assert m.MergeConfig(dedup="fuzzy").faults() and m.MergeConfig(keys=()).faults() and m.MergeConfig(dedup="custom", resolve="custom").faults()


def test_fuzzy_merge(spark):
    a = frame(spark, "id,name", [("g", "Jonathan Smith"), ("g", "Jonathan Smyth"), ("g", "Someone Else"), ("h", "Jonathan Smith")])
    out = m.merge([m.Source("a", a)], m.MergeConfig(dedup="fuzzy", block=("id",), threshold=0.85, resolve="first"))
    assert got(out) == [("g", "Jonathan Smith"), ("g", "Someone Else"), ("h", "Jonathan Smith")]


def test_clusters_of_a_chain(spark):
    found = clusters(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a int, b int"), "a", "b").collect()
    assert {r["node"]: r["cluster"] for r in found} == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}


CASES = [
    ([("1", "a"), ("2", "b"), ("3", "c")], [("1", "A"), ("2", "b"), ("4", "d")], (1, 1, 1)),
    ([("1", ""), ("2", 'say "x"')], [("1", "filled"), ("2", 'say "x"')], (0, 0, 1)),
    ([], [("1", "a")], (1, 0, 0)),
    ([("1", "a"), ("1", "a"), ("1", "b")], [("1", "a"), ("1", "b")], (0, 1, 1)),
    ([("1", None)], [("1", "")], (0, 0, 1)),
]


@pytest.mark.parametrize(("old", "new", "n"), CASES)
def test_key_diff_counts_and_apply(spark, old, new, n):
    a, b = frame(spark, "id,v", old), frame(spark, "id,v", new)
    changes = d.diff(a, b, d.DiffConfig("key_based"))
    by = {r["op"]: r["n"] for r in d.statistics(changes).collect()}
    assert (by.get("INSERT", 0), by.get("DELETE", 0), by.get("UPDATE", 0)) == n
    assert got(d.apply(a, changes)) == sorted(new, key=str)


def test_thousand_rows(spark):
    old = [(str(i), f"n{i}") for i in range(1, 1001)]
    new = [(i, v + "!" if int(i) % 3 == 0 else v) for i, v in old if int(i) % 3 == 0 or int(i) % 7] + [(str(i), "new") for i in range(1001, 1101)]
    a, b = frame(spark, "id,v", old), frame(spark, "id,v", new)
    by = {r["op"]: r["n"] for r in d.statistics(d.diff(a, b, d.DiffConfig("key_based"))).collect()}
    assert by == {"UPDATE": 333, "DELETE": 95, "INSERT": 100}


@pytest.mark.parametrize("mode", ["key_based", "field_by_field"])
def test_random_round_trips(spark, mode):
    rnd = random.Random(mode)
    rows = lambda n: [(f"{rnd.randint(0, 30):02d}", rnd.choice("abc")) for _ in range(n)]
    old, new = rows(60), rows(50)
    a, b = frame(spark, "id,v", old), frame(spark, "id,v", new)
    assert got(d.apply(a, d.diff(a, b, d.DiffConfig(mode, order="id")))) == sorted(new)


def test_moves_timestamps_files_and_damage(spark, tmp_path):
    a, b = frame(spark, "pos,v", [("1", "x"), ("2", "y"), ("3", "z")]), frame(spark, "pos,v", [("1", "y"), ("2", "x"), ("3", "z")])
    assert sorted((r["row_index"], r["new_index"]) for r in d.moves(a, b, "pos", "pos").collect()) == [(0, 1), (1, 0)]
    t = d.DiffConfig("timestamp_based", timestamp="ts")
    changes = d.diff(frame(spark, "id,ts", [("1", "2024-02"), ("2", "2024-01")]), frame(spark, "id,ts", [("1", "2024-01"), ("2", "2024-02")]), t)
    assert [r["key"] for r in changes.collect()] == ['{"id":"2"}']
    whole = d.diff(a, b, d.DiffConfig("field_by_field", order="pos"))
    d.write_delta(whole, f"file://{tmp_path}/delta", a.columns)
    header, back = d.read_delta(spark, f"file://{tmp_path}/delta")
    assert header["columns"] == ["pos", "v"] and got(d.apply(a, back)) == got(b)
    assert d.damaged(back).isEmpty() and d.damaged(back.withColumn("new", F.array(F.lit("?")))).count() == back.where("op <> 'MOVE'").count()
    assert got(d.apply(a, d.from_json(d.to_json(back)))) == got(b)
    assert d.size_ratio(b, whole).first()["ratio"] > 0
    with pytest.raises(ValueError):
        d.diff(a, b, d.DiffConfig("key_based", keys=("nope",)))


def test_best_encoding(spark):
    df = spark.createDataFrame([(0, i, "same") for i in range(50)], "p int, k int, v string")
    assert e.best_encoding(df, "v", ["k"], ["p"]).first()["encoding"] == "run_length"


def test_positions_over_many_partitions(spark):
    """Positions are 0 to n - 1 without gaps, whatever the partitions, and ties and nulls count too."""
    df = spark.range(0, 300_000, 1, 23).select((F.col("id") * 7919 % 300_007).alias("k"), F.when(F.col("id") % 1000 == 0, None).otherwise(F.col("id") % 5000).alias("o"))
    got = d._numbered(df, "o", ["k"]).agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()
    assert tuple(got) == (300_000, 300_000, 0, 299_999)
    shifted = df.where("k <> 12345").withColumn("o", F.col("o"))
    assert d.diff(df, df, d.DiffConfig("field_by_field", order="o")).isEmpty()
    changes = d.diff(df, shifted, d.DiffConfig("field_by_field", order="o"))
    assert d.apply(df, changes).exceptAll(shifted).isEmpty() and changes.where("op = 'DELETE'").count() == df.count() - shifted.count()


def test_content_diff_counts_repeats(spark):
    a, b = frame(spark, "v", [("x",), ("x",), ("y",)]), frame(spark, "v", [("y",), ("y",)])
    changes = d.diff(a, b)
    assert got(d.apply(a, changes)) == got(b) and changes.where("op = 'DELETE'").count() == 2
    c, e2 = frame(spark, "v,w", [("a|b", "c"), (None, "z")]), frame(spark, "v,w", [("a", "b|c"), ("", "z")])
    assert d.diff(c, e2).count() == 4


def test_numbers_are_later_as_numbers(spark):
    t = d.DiffConfig("timestamp_based", timestamp="ts")
    assert d.diff(frame(spark, "id,ts", [("1", "9"), ("2", "10")]), frame(spark, "id,ts", [("1", "10"), ("2", "9")]), t).select("key").collect()[0][0] == '{"id":"1"}'


def test_keyless_and_hot_keys(spark):
    """Null keys match by content; one key with a third of the rows doesn't gather its rows unless it changes."""
    old = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("id"), (F.col("id") % 7).alias("v"))
    new = old.withColumn("v", F.when(F.col("id").isNull() & (F.col("v") == 3), 99).otherwise(F.col("v")))
    changes = d.diff(old, new, d.DiffConfig("key_based"))
    n = old.where("id is null and v = 3").count()
    assert {r["op"]: r["n"] for r in d.statistics(changes).collect()} == {"INSERT": n, "DELETE": n}
    assert d.apply(old, changes).exceptAll(new).isEmpty()


def test_names_of_ones_own(spark):
    a = frame(spark, "id,_row,_tag,_key,_source", [("1", "r", "t", "k", "s"), ("1", "q", "u", "l", "z"), (None, "r2", "t2", "k2", "s2")])
    for how in ("first", "newest", "merge_values"):
        out = m.merge([m.Source("a", a)], m.MergeConfig(resolve=how))
        assert out.columns == a.columns and out.count() == 2
    first = m.merge([m.Source("a", a)], m.MergeConfig(resolve="first"), "origin").where("id = '1'").first()
    assert tuple(first)[1:] == ("r", "t", "k", "s", "a")


def test_callbacks_estimates_and_files(spark, tmp_path):
    a = frame(spark, "id,v", [("1", "x"), ("2", "y")])
    seen = []
    assert m.merge_with_callback([m.Source("a", a)], m.MergeConfig(), lambda r: seen.append(r["id"])) == 2 and sorted(seen) == ["1", "2"]
    failed = []
    assert m.merge_with_callback([m.Source("a", a)], m.MergeConfig(), lambda r: 1 / 0, failed.append) == 1 and len(failed) == 1
    assert m.estimates([m.Source("a", a)]).count() == 1
    (tmp_path / "s.csv").write_text("id;v\n3;z\n")
    assert got(m.merge([m.Source("a", a), m.from_file(spark, "b", f"{tmp_path}/s.csv")], m.MergeConfig())) == [("1", "x"), ("2", "y"), ("3", "z")]
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        d.diff_files(spark, f"{tmp_path}/e.csv", f"{tmp_path}/s.csv")
