"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from deltaloom.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: "NULL" if pd.api.types.is_scalar(v) and pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    df = df[sorted(df.columns)]
    whole = {c for c in df.columns if pd.api.types.is_float_dtype(df[c]) and (df[c].dropna() % 1 == 0).all()}
    return sorted(tuple(str(int(v)) if c in whole and not pd.isna(v) else cell(v) for c, v in zip(df.columns, r, strict=True)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    whole = lambda df: df.astype({c: "float64" for c in df.columns if pd.api.types.is_integer_dtype(df[c])})
    assert rows(whole(got)) == rows(whole(want))


def test_ordered_queries_keep_their_order(spark, sf, con):
    for name in ("top_k", "limit_offset", "order_by_many", "group_having", "top_revenue_groups"):
        assert [tuple(r)[:1] for r in QUERIES[name](spark, sf).collect()] == [r[:1] for r in con.sql(ORACLE_SQL[name]).fetchall()]


def test_plans_push_down_and_prune(spark, sf):
    plan = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    text = plan("filter_equal")
    assert "PushedFilters: [IsNotNull(l_returnflag), IsNotNull(l_quantity), EqualTo(l_returnflag,R), EqualTo(l_quantity,10.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in text
    assert "TakeOrderedAndProject" in plan("top_k")
    assert "Python" not in plan("merge_keep_newest") + plan("diff_by_key") + plan("validation_errors")


def test_token_bucket_equals_a_loop(spark, sf):
    from deltaloom.streaming.streams import Bucket

    bucket, state, want = Bucket(rate=1 / 3600, burst=3), {}, {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: (r["ts"], r["event_id"])):
        at = (r["ts"] - pd.Timestamp("1970-01-01").to_pydatetime()).total_seconds()
        state[r["user_id"]], want[r["event_id"]] = bucket.step(state.get(r["user_id"], (3.0, 0.0, 0.0)), at)
    assert {r["event_id"]: r["admitted"] for r in QUERIES["token_bucket"](spark, sf).collect()} == want


def test_entry_without_the_optional_subpackage(tmp_path):
    import subprocess
    import sys

    code = "import sys; sys.modules['deltaloom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(QUERIES)), "False"]
