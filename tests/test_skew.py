"""Results stay whole when one key holds most of the rows."""

from collections import Counter

from conftest import rows
from pyspark.sql import functions as F

from tallyward.operators import graph, lineage, registry
from tallyward.operators.pii import detect_pii_values
from tallyward.operators.quality import QualityRule, evaluate_rules, profile_columns


def test_hot_reference(spark):
    assets = spark.range(50).selectExpr("concat('a', id) AS id", "concat('t', id) AS name", "concat('db.s.t', id) AS external_id")
    statements = spark.range(3000).selectExpr(
        "concat('job', id % 40) AS transform_id", "concat('etl/', id % 7, '.sql') AS logic",
        "array(if(id % 3 = 0, 's.t0', concat('s.t', id % 50)), 'missing.t') AS sources",
        "array(concat('db.s.t', (id + 1) % 50)) AS targets")
    want = set()
    for i in range(3000):
        source = 0 if i % 3 == 0 else i % 50
        target = (i + 1) % 50
        if source != target:
            want.add((f"a{source}", f"a{target}", f"job{i % 40}"))
    got = lineage.table_edges(statements, lineage.match_index(assets))
    assert {(r["source_id"], r["target_id"], r["transform_id"]) for r in rows(got)} == want
    assert {r["confidence"] for r in rows(got)} == {0.9}


def test_hub_closure_with_and_without_broadcast(spark, monkeypatch):
    edges = spark.range(2000).selectExpr(
        "if(id % 3 = 0, 'hub', concat('n', id % 90)) AS source_id", "concat('n', id % 400) AS target_id"
    ).union(spark.createDataFrame([("n5", "hub"), ("x", "n1")], "source_id string, target_id string"))
    adjacent = {}
    for r in edges.collect():
        adjacent.setdefault(r["source_id"], set()).add(r["target_id"])
    seen, todo = set(), ["hub"]
    while todo:
        for n in adjacent.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    want = seen - {"hub"}
    assert {r["id"] for r in rows(graph.impact(edges, "hub"))} == want
    monkeypatch.setattr(graph, "BROADCAST_IDS", 0)
    assert {r["id"] for r in rows(graph.impact(edges, "hub"))} == want


def test_model_with_most_versions(spark):
    models = spark.range(4).selectExpr(
        "concat('m', id) AS id", "'n' AS name", "'d' AS description", "'o' AS owner", "'u' AS use_case",
        "'b' AS business_domain", "'f' AS framework", "'t' AS model_type", "'high' AS risk_tier", "'live' AS deployment_status")
    versions = spark.range(900).selectExpr(
        "if(id % 3 < 2, 'm0', concat('m', id % 3)) AS model_id", "string(id) AS version_number", "'dev' AS stage", "map('a', 1.0D) AS metrics")
    assessments = spark.createDataFrame([("m0", "1", 1, "high", "c", ["x"], ["y"]), ("m0", "2", 2, "low", "c", ["z"], ["y"])],
        "model_id string, id string, created_at int, risk_tier string, category string, risk_factors array<string>, required_actions array<string>")
    got = rows(registry.model_cards(models, versions, assessments))
    assert Counter(r["model_id"] for r in got) == {"m0": 600, "m2": 300, "m1": 1, "m3": 1}
    assert {r["assessed_tier"] for r in got if r["model_id"] == "m0"} == {"low"}
    assert [r["version_number"] for r in got if r["model_id"] == "m3"] == [None]


def test_hot_values_and_long_texts(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("v"),
        F.when(F.col("id") == 2999, F.concat(F.repeat(F.lit("word "), 20000), F.lit("reach me at a.b@example.org"))).alias("text"),
    )
    result = rows(evaluate_rules(df, [QualityRule("u", "unique", "v")]))[0]
    assert result["records_failed"] == 1000 and result["sample_failures"] == ["hot"] * 10
    assert {r["column"]: r["distinct_count"] for r in rows(profile_columns(df))} == {"v": 2001, "text": 1}
    assert [(r["column"], r["entity"]) for r in rows(detect_pii_values(df))] == [("text", "EMAIL_ADDRESS")]
