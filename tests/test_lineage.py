from conftest import rows
from pyspark.sql import functions as F

from tallyward.operators import graph, lineage, openlineage, scripts

ETL = """
-- builds mart tables; INSERT INTO dead.a SELECT * FROM dead.b;
INSERT INTO mart.revenue SELECT * FROM crm.orders JOIN crm.buyers ON buyers.id = orders.buyer; -- FROM nowhere.x
INSERT INTO mart.daily SELECT ';' AS d, '-- from a.b' AS e, day FROM crm.orders WHERE status IN ('it''s', 'x');
/* INSERT INTO dead.t SELECT * FROM dead.s; */
CREATE OR REPLACE TABLE mart.both AS SELECT * FROM crm.orders o, "crm"."buyers" AS c;
MERGE INTO mart.wide t USING crm.buyers s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = 1;
WITH recent AS (SELECT * FROM crm.visits), Named (a) AS (SELECT 1) INSERT INTO mart.seen SELECT * FROM recent r JOIN named USING (id) LEFT JOIN crm.pages;
CREATE VIEW mart.years AS SELECT extract(year FROM o.ts), trim(both 'x' FROM o.n), o.a IS NOT DISTINCT FROM o.b FROM crm.orders o;
INSERT INTO mart.chain SELECT * FROM a.x JOIN b.y USING (id) JOIN c.z NATURAL JOIN d.w CROSS JOIN e.v;
DELETE FROM crm.orders;
SELECT * FROM crm.payments
"""


def _catalog(spark, names):
    return spark.createDataFrame(
        [(i, n.split(".")[-1], n, "table", "unclassified") for i, n in names],
        "id string, name string, external_id string, asset_type string, sensitivity_level string",
    )


def test_sql_statements(spark):
    df = spark.createDataFrame([("etl/a.sql", ETL)], "path string, content string")
    got = {(r["targets"][0], tuple(sorted(r["sources"]))) for r in rows(scripts.sql_table_refs(df))}
    assert got == {
        ("mart.revenue", ("crm.buyers", "crm.orders")), ("mart.daily", ("crm.orders",)), ("mart.both", ("crm.buyers", "crm.orders")),
        ("mart.wide", ("crm.buyers",)), ("mart.seen", ("crm.pages", "crm.visits")), ("mart.years", ("crm.orders",)),
        ("mart.chain", ("a.x", "b.y", "c.z", "d.w", "e.v")),
    }


def test_script_kinds_dbt_and_python(spark):
    df = spark.createDataFrame(
        [
            ("m/stg.sql", "select * from {{ ref('raw_a') }} join {{ source('crm', 'b') }}"),
            ("q.sql", "select 1"),
            ("dag.py", "from airflow import DAG\nsql = '''insert into w.t select * from w.s'''\nx = \"insert into w.no select 1 from w.x\""),
            ("job.py", "a = spark.read.parquet(\"s3://b/in\")\n"
                       "b = spark.read.format('jdbc').option('dbtable', 'shop.orders').load()\n"
                       "c = spark.read.jdbc(url, 'shop.c')\n"
                       "a.write.mode('overwrite').parquet('out/x')\n"
                       "b.write.saveAsTable('t.y')\nwrite_table(a, 'an.z')\nd = pd.read_csv('f.csv')\n"
                       "spark.sql(\"insert into w.t2 select * from w.s2\")"),
            ("util.py", "print(1)"),
            ("notes.txt", "x"),
        ],
        "path string, content string",
    )
    kinds = {r["path"]: r["k"] for r in df.select("path", scripts.script_kind(F.col("path"), F.col("content")).alias("k")).collect()}
    assert kinds == {"m/stg.sql": "dbt_model", "q.sql": "sql_script", "dag.py": "airflow_dag",
                     "job.py": "spark_job", "util.py": "python_script", "notes.txt": "unknown"}
    dbt = rows(scripts.dbt_refs(df))
    assert [(r["targets"], r["sources"]) for r in dbt] == [(["stg"], ["raw_a", "crm.b"])]
    embedded = {(r["path"], r["targets"][0], r["sources"][0]) for r in rows(scripts.embedded_sql(df))}
    assert embedded == {("dag.py", "w.t", "w.s"), ("job.py", "w.t2", "w.s2")}
    literals = {(r["direction"], r["dataset"]) for r in rows(scripts.script_dataset_literals(df)) if r["path"] == "job.py"}
    assert literals == {("read", "s3://b/in"), ("read", "shop.orders"), ("read", "shop.c"), ("read", "f.csv"),
                        ("write", "out/x"), ("write", "t.y"), ("write", "an.z")}


def test_resolution_order(spark):
    assets = _catalog(spark, [("a", "db1.shop.orders"), ("b", "db2.crm.orders"), ("c", "db1.shop.customers")])
    refs = spark.createDataFrame(
        [("db1.shop.orders",), ("shop.orders",), ("customers",), ("orders",), ("nowhere.nothing",),
         ("wrong.customers",), (" `DB1.shop.Orders` ",), ("s3://db1/shop/customers",), ("",)], "ref string")
    got = {r["ref"]: (r["asset_id"], r["confidence"]) for r in rows(lineage.resolve_refs(refs, lineage.match_index(assets)))}
    assert got == {"db1.shop.orders": ("a", 1.0), "shop.orders": ("a", 0.9), "customers": ("c", 0.75),
                   "orders": ("a", 0.4), "wrong.customers": ("c", 0.75), " `DB1.shop.Orders` ": ("a", 1.0),
                   "s3://db1/shop/customers": ("c", 0.9)}


def test_name_only_match(spark):
    assets = spark.createDataFrame([("m", "Ledger", "x://one/two"), ("n", "other", "a.z"), ("o", "other", "b.z")],
                                   "id string, name string, external_id string")
    refs = spark.createDataFrame([("ledger",), ("any.other",)], "ref string")
    got = {r["ref"]: (r["asset_id"], r["confidence"]) for r in rows(lineage.resolve_refs(refs, lineage.match_index(assets)))}
    assert got == {"ledger": ("m", 0.7), "any.other": ("n", 0.4)}


def test_rebuild_is_idempotent(spark):
    names = ["crm.orders", "crm.buyers", "mart.revenue", "mart.daily", "mart.both", "mart.wide", "crm.orders.total", "mart.daily.amount"]
    assets = _catalog(spark, [(f"id{i}", f"db.{n}") for i, n in enumerate(names)])
    df = spark.createDataFrame([("etl/a.sql", ETL)], "path string, content string")
    statements = scripts.script_statements(df).select(
        F.lit("job").alias("transform_id"), F.col("path").alias("logic"), "sources", "targets")
    columns = spark.createDataFrame([("job", "etl/a.sql", "crm.orders", "total", "mart.daily", "amount")],
        "transform_id string, logic string, source_table string, source_column string, target_table string, target_column string")
    edges = lineage.rebuild_lineage(assets, statements, columns).cache()
    assert edges.count() == 7 and edges.where("lineage_type = 'column'").count() == 1
    assert {r["confidence"] for r in rows(edges)} == {0.9}
    assert lineage.rebuild_lineage(assets, statements, columns, edges).count() == 0
    assert rows(lineage.rebuild_counts(statements, edges)) == [{"assets_with_lineage": 1, "edges_created": 7}]
    assert lineage.graph_nodes(edges, assets).count() == 6
    assert lineage.graph_nodes(edges, assets, "column").count() == 2


def test_merge_and_parents(spark):
    edges = spark.createDataFrame([("a", "b", "x/one.sql"), ("a", "b", "y/two.py"), ("a", "b", "z/one.sql"), ("b", "c", None)],
                                  "source_id string, target_id string, logic string")
    got = {(r["source_id"], r["target_id"], r["transform"], r["n_transforms"]) for r in rows(lineage.merge_edges(edges))}
    assert got == {("a", "b", "one.sql", 2), ("a", "b", "two.py", 2), ("b", "c", None, 0)}
    many = spark.range(3000).selectExpr("'a' AS source_id", "'b' AS target_id", "concat('x/s', id, '.sql') AS logic")
    merged = lineage.merge_edges(many)
    assert merged.columns == lineage.merge_edges(edges).columns and merged.where("n_transforms = 3000").count() == 3000
    nodes = spark.createDataFrame([("db.t.c", "c"), ("odd", "c"), (None, "solo")], "external_id string, name string")
    assert [(r["table_key"], r["table_name"]) for r in rows(lineage.column_parent_table(nodes))] == [
        ("db.t", "t"), ("odd", "odd"), ("solo", "solo")]


def test_impact_is_a_fixpoint(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "b"), ("y", "z")]
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    got = {r["id"]: r["depth"] for r in rows(graph.impact(edges, "a"))}
    assert got == {"b": 1, "c": 2, "d": 3}
    reach = set(got) | {"a"}
    assert all(t in reach for s, t in pairs if s in reach)
    assert {r["id"] for r in rows(graph.focus_lineage(edges, "b"))} == {"a", "b", "c", "d", "x"}
    assert {r["id"] for r in rows(graph.impact(edges, "a", max_depth=1))} == {"b"}
    chain = spark.range(15).selectExpr("cast(id as string) source_id", "cast(id + 1 as string) target_id")
    assert {int(r["id"]): r["depth"] for r in rows(graph.impact(chain, "0"))} == {i: i for i in range(1, 16)}


def test_neighbours(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source_id string, target_id string")
    assets = _catalog(spark, [(i, f"t.{i}") for i in "abcde"])
    got = {r["id"]: r["is_center"] for r in rows(lineage.asset_neighbours(edges, assets, "b"))}
    assert got == {"a": False, "b": True, "c": False}
    assert [r["id"] for r in rows(lineage.asset_neighbours(edges, assets, "e"))] == ["e"]


EVENT = """{"eventType":"COMPLETE","run":{"runId":"r1"},"job":{"namespace":"etl","name":"load"},
"inputs":[{"namespace":"pg","name":"shop.orders"},{"namespace":"pg","name":"shop.customers"},{"namespace":"pg"}],
"outputs":[{"namespace":"pg","name":"analytics.customer_revenue","facets":{"columnLineage":{"fields":
{"revenue":{"inputFields":[{"namespace":"pg","name":"shop.orders","field":"total_amount"},{"name":"shop.orders"}]}}}}}]}"""


def test_openlineage_ingest(spark):
    raw = spark.createDataFrame([(EVENT,), (EVENT.replace("COMPLETE", "START"),), ('{"eventType":"START"}',)], "value string")
    parsed = openlineage.parse_openlineage(raw)
    assert {(r["job_namespace"], r["job_name"]) for r in rows(parsed)} == {("etl", "load"), ("default", "unknown_job")}
    assets = spark.createDataFrame([("o1", "orders", "db.shop.orders", None)],
                                   "id string, name string, external_id string, alias string")
    nodes, edges = openlineage.ingest(parsed, assets)
    nodes, edges = nodes.cache(), edges.cache()
    assert {(r["external_id"], r["asset_type"]) for r in rows(nodes)} == {
        ("pg:shop.customers", "dataset"), ("pg:analytics.customer_revenue", "dataset"),
        ("db.shop.orders.total_amount", "column"), ("pg:analytics.customer_revenue.revenue", "column"),
        ("openlineage://etl/load", "etl_pipeline")}
    assert edges.where("lineage_type = 'table'").count() == 2
    assert edges.where("lineage_type = 'column'").count() == 1
    assert {r["confidence"] for r in rows(edges)} == {1.0}
    catalog = assets.unionByName(nodes.select("id", "name", "external_id", "alias"))
    again = openlineage.ingest(parsed, catalog, edges)
    assert again[0].count() == 0 and again[1].count() == 0
