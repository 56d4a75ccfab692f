"""What edges of statements cost: no sort in their grouping, one shuffle of pairs, and the rows that this must not change."""

import pytest
from conftest import rows

from tallyward.operators import lineage

SCHEMA = "transform_id string, logic string, sources array<string>, targets array<string>"
COLUMNS = "transform_id string, logic string, source_table string, source_column string, target_table string, target_column string"


@pytest.fixture(scope="module")
def assets(spark):
    paths = [("a", "db.a"), ("b", "db.b"), ("c", "db.c"), ("aa", "db.a.x"), ("bb", "db.b.x")]
    return spark.createDataFrame(
        [(i, p.split(".")[-1] if i != "aa" else "ax", p) for i, p in paths], "id string, name string, external_id string"
    )


def statements(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def facts(edges):
    keys = ("source_id", "target_id", "transform_id", "lineage_type", "logic")
    return sorted((tuple(r[k] for k in keys) for r in rows(edges)), key=str)


def test_edges_are_grouped_without_a_sort(spark, assets):
    given = statements(spark, ("t", "l", ["db.a"], ["db.b"]))
    stored = spark.createDataFrame([("x", "y", "t")], "source_id string, target_id string, transform_id string")
    index = lineage.match_index(assets).localCheckpoint()
    columns = spark.createDataFrame([("t", "l", "db.a", "x", "db.b", "x")], COLUMNS)
    for edges in (lineage.table_edges(given, index, stored), lineage.column_edges(columns, index, stored),
                  lineage.rebuild_lineage(assets, given, columns, stored)):
        plan = physical(edges)
        assert "SortAggregate" not in plan and "SortMergeJoin" not in plan
        assert plan.count("Exchange hashpartitioning") == 1


def test_smallest_logic_and_best_confidence_of_a_repeated_edge(spark, assets):
    given = statements(spark, ("t", "é", ["db.a"], ["db.b"]), ("t", "z", ["a"], ["db.b"]), ("t", None, ["db.a"], ["db.b"]),
                       ("t", None, ["db.a"], ["db.c"]), ("t", "Z", ["nowhere.q", None], ["db.b"]),
                       ("t", "A", None, ["db.b"]), ("t", "A", ["db.a"], None), ("t", "", ["db.b"], ["db.b", "db.c"]))
    edges = lineage.table_edges(given, lineage.match_index(assets))
    assert facts(edges) == sorted([("a", "b", "t", "table", "z"), ("a", "c", "t", "table", None),
                                   ("b", "c", "t", "table", "")], key=str)
    assert {r["confidence"] for r in rows(edges)} == {1.0}


def test_existing_edges_and_table_edges_hide_later_ones(spark, assets):
    given = statements(spark, ("t", "l", ["db.a"], ["db.b"]), ("t", "l", ["db.a"], ["db.c"]), ("t", "k", ["db.a.x"], ["db.b.x"]),
                       (None, "n", ["db.a.x"], ["db.b.x"]))
    columns = spark.createDataFrame(
        [("t", "c", "db.a", "x", "db.b", "x"), ("u", "c", "db.a", "x", "db.b", "x"), (None, "c", "db.a", "x", "db.b", "x")], COLUMNS)
    stored = spark.createDataFrame([("a", "b", "t"), ("a", "b", "t"), ("a", "c", None), ("aa", "bb", None)],
                                   "source_id string, target_id string, transform_id string")
    want = [("a", "c", "t", "table", "l"), ("aa", "bb", "t", "table", "k"), ("aa", "bb", "u", "column", "c"),
            ("aa", "bb", None, "table", "n"), ("aa", "bb", None, "column", "c")]
    assert facts(lineage.rebuild_lineage(assets, given, columns, stored)) == sorted(want, key=str)


def test_the_same_edges_where_nothing_is_broadcast(spark, assets):
    given = spark.range(400).selectExpr(
        "concat('t', id % 3) AS transform_id", "concat('l', id) AS logic",
        "array(if(id % 2 = 0, 'db.a', 'db.b'), 'no.where') AS sources", "array('db.c', 'db.b') AS targets")
    index = lineage.match_index(assets)
    near = facts(lineage.table_edges(given, index))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert facts(lineage.table_edges(given, index)) == near and len(near) == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
