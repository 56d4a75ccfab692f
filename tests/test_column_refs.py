"""Column references of script text."""

import time

import pytest
from conftest import rows

from tallyward.operators import column_refs, lineage


def refs(spark, sql, path="a.sql"):
    df = spark.createDataFrame([(path, sql)], "path string, sql string")
    return {(r["target_table"], r["target_column"], r["source_table"], r["source_column"]) for r in rows(column_refs.column_refs_in_sql(df))}


CASES = {
    "names, aliases and expressions": (
        "INSERT INTO mart.rev SELECT o.id, o.total * o.rate AS amount, upper(c.name) label, 1 AS one FROM crm.orders o JOIN \"crm\".\"buyers\" AS c ON o.b = c.id",
        {("mart.rev", "id", "crm.orders", "id"), ("mart.rev", "amount", "crm.orders", "total"), ("mart.rev", "amount", "crm.orders", "rate"),
         ("mart.rev", "label", "crm.buyers", "name")},
    ),
    "column list, single source": (
        "insert into t (a, `b`) select x, coalesce(y, z) from s where w > 0; select q from r",
        {("t", "a", "s", "x"), ("t", "b", "s", "y"), ("t", "b", "s", "z")},
    ),
    "star and unnamed": ("CREATE TABLE t AS SELECT *, s.*, a + b, count(*), c FROM s", {("t", "c", "s", "c")}),
    "derived tables": (
        "CREATE OR REPLACE VIEW v AS SELECT q.k, q.m FROM (SELECT a.k, max(b.v + (a.w)) AS m FROM a JOIN (SELECT v, j FROM inner_b) b ON a.j = b.j GROUP BY a.k) AS q",
        {("v", "k", "a", "k"), ("v", "m", "inner_b", "v"), ("v", "m", "a", "w")},
    ),
    "common tables": (
        "WITH src AS (SELECT * FROM raw.orders), n (p, r) AS (SELECT s.id, s.total FROM src s) INSERT INTO t SELECT p AS id, r FROM n",
        {("t", "id", "raw.orders", "id"), ("t", "r", "raw.orders", "total")},
    ),
    "recursion ends": (
        "INSERT INTO t WITH RECURSIVE w AS (SELECT id, up FROM nodes UNION ALL SELECT n.id, w.up FROM nodes n JOIN w ON n.up = w.id) SELECT id, up FROM w",
        {("t", "id", "nodes", "id"), ("t", "up", "nodes", "up")},
    ),
    "set operations go by place": (
        "insert into t select a as k, b from x union all select c, d from y except select e, f from z",
        {("t", "k", "x", "a"), ("t", "b", "x", "b"), ("t", "k", "y", "c"), ("t", "b", "y", "d"), ("t", "k", "z", "e"), ("t", "b", "z", "f")},
    ),
    "case, windows, casts, literals, scalar subqueries": (
        """create table t as select case when x = 'a, b (' then y else z end as k, sum(v) over (partition by g order by h desc) w,
           cast(d as decimal(10, 2)) as e, extract(year from ts) as yr, (select max(m) from other) as top, n::int as n2,
           a between lo and hi as inside, l is not distinct from r as same, date '2024-01-01' as fixed -- c from nowhere
           /* , z */ from s""",
        {("t", "k", "s", "x"), ("t", "k", "s", "y"), ("t", "k", "s", "z"), ("t", "w", "s", "v"), ("t", "w", "s", "g"), ("t", "w", "s", "h"),
         ("t", "e", "s", "d"), ("t", "yr", "s", "ts"), ("t", "top", "other", "m"), ("t", "n2", "s", "n"), ("t", "inside", "s", "a"),
         ("t", "inside", "s", "lo"), ("t", "inside", "s", "hi"), ("t", "same", "s", "l"), ("t", "same", "s", "r")},
    ),
    "bracketed select and nested brackets": (
        "create table t as ((select ((a)) as b, f(g(h, i), j) as k from s))",
        {("t", "b", "s", "a"), ("t", "k", "s", "h"), ("t", "k", "s", "i"), ("t", "k", "s", "j")},
    ),
    "several sources": (
        "insert into t select a, x.b, nowhere.c, y.d from x, y",
        {("t", "b", "x", "b"), ("t", "c", "nowhere", "c"), ("t", "d", "y", "d")},
    ),
    "what is no such statement": ("update t set a = b; insert into t values (1); create index i on t (a); merge into t using s on a = b", set()),
}


@pytest.fixture(scope="module")
def found(spark):
    """The references of all cases, as written and in capitals."""
    texts = [(f"{name}|{way}", sql.upper() if way == "upper" else sql) for name, (sql, _) in CASES.items() for way in ("plain", "upper")]
    df = spark.createDataFrame(texts, "path string, sql string")
    out = {}
    for r in rows(column_refs.column_refs_in_sql(df)):
        out.setdefault(r["path"], set()).add((r["target_table"], r["target_column"], r["source_table"], r["source_column"]))
    return out


@pytest.mark.parametrize("name", CASES)
def test_references(found, name):
    wanted = CASES[name][1]
    assert found.get(f"{name}|plain", set()) == wanted
    assert found.get(f"{name}|upper", set()) == {tuple(x.upper() for x in w) for w in wanted}


def test_scripts_and_edges(spark):
    scripts = spark.createDataFrame(
        [("etl/a.sql", CASES["names, aliases and expressions"][0]), ("job.py", 'x = """insert into mart.rev select s.total as amount from crm.orders s"""\ny = "insert"'),
         ("none.sql", None), ("empty.sql", "")],
        "path string, content string",
    )
    found = column_refs.column_refs(scripts)
    assert {r["path"] for r in rows(found)} == {"etl/a.sql", "job.py"}
    assets = spark.createDataFrame(
        [(n, n.split(".")[-1], n) for n in ("db.crm.orders.total", "db.mart.rev.amount", "db.mart.rev.id", "db.crm.orders.id")], "id string, name string, external_id string"
    )
    edges = lineage.column_edges(found.withColumnsRenamed({"path": "transform_id"}).selectExpr("*", "transform_id AS logic"), lineage.match_index(assets))
    assert {(r["source_id"], r["target_id"], r["transform_id"], r["confidence"]) for r in rows(edges)} == {
        ("db.crm.orders.total", "db.mart.rev.amount", "etl/a.sql", 0.9), ("db.crm.orders.id", "db.mart.rev.id", "etl/a.sql", 0.9),
        ("db.crm.orders.total", "db.mart.rev.amount", "job.py", 0.9),
    }


def test_stays_in_the_row(spark):
    df = spark.createDataFrame([("a.sql", "x")], "path string, sql string")
    plan = column_refs.column_refs_in_sql(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_odd_and_long_text(spark):
    """Unbalanced brackets and hostile runs end, and time follows length."""
    for sql in ("insert into t select ((a from s", "insert into t select a)) from s", "insert into t select " + "(" * 300 + "a" + ")" * 300 + " from s",
                "create table t as select 'x from s", "insert into t select a, b from s"):
        refs(spark, sql)
    took = []
    for n in (100, 800):
        wide = "insert into t select " + ", ".join(f"f(c{i}, g(d{i})) as e{i}" for i in range(n)) + " from s"
        start = time.perf_counter()
        assert len(refs(spark, wide)) == 2 * n
        took.append(time.perf_counter() - start)
    assert took[1] < 30
