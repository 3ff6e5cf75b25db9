"""The SQL surface, with one test for each fault that the engine must not have."""

import pytest

from deltaloom.operators.engine import Engine, EngineConfig, TimedCache, TooManyRows, names_in, rewrite

EMPLOYEES = [["1", "Ann", "ann@example.com", "Engineering", "75000", "30"], ["2", "Bo", "bo@example.com", "Marketing", "65000", "25"], ["3", "Cy", "cy@example.com", "Engineering", "80000", "35"], ["4", "Di", "", "Sales", "NULL", "28"], ["5", "E.d", "ed@example.com", "Engineering", "70000", "32"]]


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.register_rows("employees", ["id", "name", "email", "department", "salary", "age"], EMPLOYEES)
    e.register("cells", spark.createDataFrame([("007",), ("200abc",), ("10.0.0.1",), ("2024-01-15",), ("999.99",), ("",), (None,)], "v string"))
    return e


def rows(engine, sql):
    return engine.execute(sql).rows()


def test_expected_facts(engine):
    assert len(rows(engine, "SELECT name FROM employees WHERE department = 'Engineering'")) == 3
    assert rows(engine, "SELECT COUNT(id) AS n FROM employees") == [(5,)]
    assert len(rows(engine, "SELECT id FROM employees LIMIT 2 OFFSET 2")) == 2
    assert len(rows(engine, "SELECT DISTINCT department FROM employees")) == 3


def test_second_run_is_a_hit_until_the_table_changes(engine):
    sql = "SELECT count(*) AS n FROM employees"
    assert not engine.execute(sql).cached and engine.execute(sql).cached and engine.statistics.hits == 1
    engine.register_rows("employees", ["id"], [["1"]])
    again = engine.execute(sql)
    assert not again.cached and again.rows() == [(1,)]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT v FROM cells WHERE try_cast(v AS DOUBLE) = 2024", []),  # a date is no number
        ("SELECT name FROM employees WHERE name LIKE '%.d'", [("E.d",)]),  # the pattern counts, and a point is a point
        ("SELECT name FROM employees WHERE id = '1' OR id = '2'", [("Ann",), ("Bo",)]),  # OR is OR
        ("SELECT name FROM employees WHERE id = '1' AND age = '99' OR id = '2'", [("Bo",)]),  # AND first
        ("SELECT department, COUNT(*) AS n FROM employees GROUP BY department", [("Engineering", 3), ("Marketing", 1), ("Sales", 1)]),
        ("SELECT department, COUNT(*) AS n FROM employees GROUP BY department HAVING COUNT(*) > 1 ORDER BY n LIMIT 1", [("Engineering", 3)]),
        ("SELECT MAX(age) AS oldest FROM employees", [("35",)]),  # an alias on an aggregate
        ("SELECT COUNT(*) FROM employees", [(5,)]),
        ("SELECT a.name FROM employees a JOIN employees b ON a.id = b.age;", []),
        ("select name from employees where id = '3' and department = 'Sales'", []),  # both conditions hold; any case
        ("SELECT v FROM cells WHERE v = '999.99'", [("999.99",)]),
        ("SELECT count(*) AS n FROM employees WHERE id = 'none'", [(0,)]),
        ("SELECT v FROM cells WHERE v NOT IN ('007', '200abc', '10.0.0.1', '2024-01-15', '999.99')", [("",)]),  # null is left out
        ("SELECT DISTINCT(department) FROM employees", [("Engineering",), ("Marketing",), ("Sales",)]),
        ("SELECT MIN(id) AS a, DISTINCT(department) AS b FROM employees", [("1", 3)]),
        ("SELECT GROUP_CONCAT(name) AS g FROM employees WHERE department REGEX '^Eng'", [("Ann,Cy,E.d",)]),
        ("SELECT 'DISTINCT(x) REGEX \"y\"' AS t", [('DISTINCT(x) REGEX "y"',)]),
    ],
)
def test_dialect(engine, sql, want):
    assert sorted(rows(engine, sql), key=str) == want


def test_rewriter():
    assert rewrite("SELECT GROUP_CONCAT(a) FROM t;") == "SELECT listagg(a, ',') WITHIN GROUP (ORDER BY a) FROM t"
    assert rewrite('SELECT "a b" FROM t') == "SELECT `a b` FROM t"
    assert rewrite("SELECT a FROM t LIMIT 0", compat=True).strip() == "SELECT a FROM t"
    assert rewrite("SELECT a FROM t LIMIT 0") == "SELECT a FROM t LIMIT 0"


def test_names_and_explain(spark, engine):
    assert names_in(spark, "SELECT * FROM employees e JOIN cells c ON e.id = c.v") == ["cells", "employees"]
    assert "Physical Plan" in engine.explain("SELECT name FROM employees")


def test_result_access_and_text(engine):
    r = engine.execute("SELECT id, name FROM employees ORDER BY id")
    assert r.row(1) == ("2", "Bo") and r.cell(0, "name") == "Ann" and r.column("id") == ["1", "2", "3", "4", "5"]
    assert r.slice(-3, 2).rows() == r.rows()[:2] and r.sort("id", ascending=False).row(0)[0] == "5"
    for bad, error in ((lambda: r.row(9), IndexError), (lambda: r.cell(0, "x"), KeyError), (lambda: r.column("x"), KeyError)):
        with pytest.raises(error):
            bad()
    q = engine.execute("SELECT 'a\"b' AS x, CAST(NULL AS STRING) AS y")
    assert q.to_csv() == '"x","y"\n"a""b",""\n' and q.to_json() == '{"data": [{"x": "a\\"b", "y": null}], "count": 1}'
    assert "NULL" in q.to_table() and q.to_table().endswith("1 rows")
    assert engine.execute("SELECT 1 AS x WHERE false").to_table() == "Empty result set"
    assert "..." in engine.execute("SELECT repeat('x', 99) AS x").to_table()


def test_indexes(engine):
    engine.create_index("employees", ("department",), "hash")
    engine.create_index("employees", ("age",), "btree")
    engine.create_index("employees", ("department", "age"), "composite")
    plan = lambda df: engine.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    engine.spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # only then the plan shows the buckets
    assert "SelectedBucketsCount: 1 out of 4" in plan(engine.lookup("employees", "department", "Engineering"))
    assert "SelectedBucketsCount: 1 out of 4" in plan(engine.lookup("employees", ("department", "age"), ("Engineering", "30")))
    engine.spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "GreaterThanOrEqual(age,28)" in plan(engine.lookup_range("employees", "age", "28", "31")) and all(n > 0 for n in engine.index_bytes().values())
    assert {r["name"] for r in engine.lookup("employees", "department", "Engineering").collect()} == {"Ann", "Cy", "E.d"}
    assert {r["name"] for r in engine.lookup_range("employees", "age", "28", "31").collect()} == {"Ann", "Di"}
    assert engine.lookup_pattern("employees", "name", "^[AB]").count() == 2
    assert engine.lookup_token("employees", "email", "EXAMPLE").count() == 4
    assert len(engine.list_indexes()) == 4 and engine.drop_index("employees", ("age",), "btree") and not engine.drop_index("employees", ("age",), "btree")
    engine.register_rows("employees", ["department"], [["New"]])
    assert engine.lookup("employees", "department", "New").count() == 1  # a stale copy isn't used
    engine.drop_index("employees", ("department", "age"), "composite")
    engine.drop_index("employees", ("email",), "fulltext")
    assert engine.optimise_indexes() == 1 and engine.lookup("employees", "department", "New").count() == 1
    engine.register_rows("notes", ["t"], [["same words"], ["same words"], ["other"]])
    assert engine.lookup_token("notes", "t", "same").count() == 2  # repeated rows stay
    with pytest.raises(ValueError):
        engine.create_index("employees", ("department",), "odd")


def test_limits_and_unload(spark):
    e = Engine(spark, EngineConfig(max_rows=2, cache_size=1))
    e.register("r", spark.range(10))
    with pytest.raises(TooManyRows):
        e.execute("SELECT id FROM r")
    assert len(e.execute("SELECT id FROM r WHERE id < 2").rows()) == 2
    e.execute("SELECT id + 1 AS id FROM r WHERE id < 2")
    assert len(e.cache) == 1
    lazy = Engine(spark, EngineConfig(cache_results=False, max_rows=2, timeout_seconds=2))
    lazy.register("lazy_r", spark.range(10))
    assert len(lazy.execute("SELECT id FROM lazy_r WHERE id < 2").rows()) == 2
    with pytest.raises(TooManyRows):
        lazy.execute("SELECT id FROM lazy_r").rows()
    lazy.register_function("slow", lambda x: (__import__("time").sleep(30), x)[1], "long")
    with pytest.raises(TimeoutError):
        lazy.execute("SELECT slow(id) AS id FROM lazy_r WHERE id < 1").rows()
    plain = Engine(spark)
    plain.register("lazy_r", spark.range(10))
    assert "limit" not in plain.plan("SELECT id FROM lazy_r")._jdf.queryExecution().optimizedPlan().toString().lower()
    with pytest.raises(Exception, match="nothing"):
        e.execute("SELECT * FROM nothing")
    assert e.statistics.failed == 2 and e.unload("r") and not e.unload("r") and e.tables() == []


def test_timed_cache():
    now = [0.0]
    c = TimedCache(size=2, least_ttl=5, most_ttl=10, stale_seconds=3, clock=lambda: now[0])
    c.put("a", 1, 1, "e1")
    now[0] = 4
    assert c.get("a") == (1, "fresh")
    now[0] = 7
    assert c.get("a") == (1, "stale") and c.renew("a", "e1", 99) and not c.renew("a", "e2", 9)
    now[0] = 16
    assert c.get("a") == (1, "fresh")
    c.put("b", 2, 9)
    c.put("c", 3, 9)
    assert c.get("a") == (None, "miss")
