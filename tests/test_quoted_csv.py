"""CSV with line breaks inside quotes, read in splits of any size."""

import csv
import io
import random

import pytest

from deltaloom.operators.engine import Engine
from deltaloom.sources import csv_source, quoted_csv


def _rows(seed, n=150):
    rnd = random.Random(seed)
    cell = lambda: "".join(rnd.choice('ab ,;"\n\r\té€' if rnd.random() < 0.3 else "abcdefgh") for _ in range(rnd.choice((0, 1, 3, 10, 40))))
    long = "x\n" * 700  # longer than many splits
    return [(str(k), cell(), long if k % 97 == 13 else cell(), "end") for k in range(n)]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def set_to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield set_to
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [211, 1000, 5003, 1 << 27])
def test_split_files_give_every_record(spark, tmp_path, small_splits, split, line_end):
    want = []
    for f in range(2):
        out = io.StringIO()
        rows = _rows(f)
        csv.writer(out, lineterminator=line_end).writerows([("id", "a", "b", "c"), *rows])
        (tmp_path / f"{f}.csv").write_bytes(("﻿" * f + out.getvalue()).encode())
        want += rows
    small_splits(split)
    options = csv_source.CsvOptions(multi_line=True, trim=False)
    got = csv_source.read_csv(spark, str(tmp_path), options)
    assert got.columns == ["id", "a", "b", "c"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if split < 10_000:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 2
    spans = quoted_csv.split_states(quoted_csv._lines(spark, str(tmp_path)), '"')
    assert spans.count() > 2 or split > 10_000


def test_odd_files(spark, tmp_path):
    options = csv_source.CsvOptions(multi_line=True)
    for name, text, want in (
        ("empty", "", []), ("header", "a,b\n", []), ("blank", 'a,b\n\n1,2\n\n  \n"3\n4",5', [("1", "2"), ("3\n4", "5")]), ("short", "a,b\n1\n2,3,4\n", [("1", ""), ("2", "3")]),
    ):
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        if name == "empty":
            assert csv_source.read_csv(spark, str(path), csv_source.CsvOptions(multi_line=True, columns=("a", "b"))).count() == 0
            continue
        assert sorted(map(tuple, csv_source.read_csv(spark, str(path), options).collect())) == want, name
    unclosed = tmp_path / "open.csv"
    unclosed.write_text('a,b\n1,"x\ny')
    assert [r["a"] for r in csv_source.read_csv(spark, str(unclosed), options).collect()] == ["1"]  # one record to the end of the file
    broken = tmp_path / "broken.csv"
    broken.write_bytes(b'a,b\n1,"x\xc3\ny"\n')
    assert csv_source.read_csv(spark, str(broken), options).count() == 1


def test_engine_loads_in_splits(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text("id,text\n" + "".join(f'{k},"line {k}\nnext"\n' for k in range(2000)))
    small_splits(4000)
    engine = Engine(spark)
    engine.load("quoted_t", str(tmp_path / "t.csv"))
    assert engine.execute("SELECT COUNT(*) AS n FROM quoted_t WHERE text LIKE '%next'").cell(0, "n") == 2000
    engine.unload("quoted_t")
