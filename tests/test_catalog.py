from conftest import rows
from pyspark.sql import functions as F
from shop import shop_tables

from tallyward.operators import catalog as c
from tallyward.operators import registry as r
from tallyward.operators import rollups as q

CATALOG = ("id string, org_id string, source_id string, external_id string, name string, asset_type string, "
           "parent_external_id string, metadata map<string,string>, sensitivity_level string, quality_score double, "
           "domain string, first_seen_at timestamp_ntz")


def test_discover_and_upsert(spark):
    shop = shop_tables(spark)
    found = c.discover_tables({"customers": shop["customers"], "orders": shop["orders"]}, "db", "shop")
    got = {x["external_id"]: x for x in rows(found)}
    assert got["db.shop.customers"]["metadata"]["row_count"] == "200"
    assert got["db.shop.customers.email"]["metadata"]["data_type"] == "string"
    assert got["db.shop"]["parent_external_id"] == "db" and len(got) == 1 + 2 + 9 - 1 + 5
    catalog = spark.createDataFrame(
        [("keep", "o", "s", "db.shop.orders", "old", "view", None, {}, "restricted", 50.0, "sales", None),
         ("other", "o", "s", "db.shop.gone", "gone", "table", None, {}, "internal", None, None, None)], CATALOG)
    once = c.upsert_assets(catalog, found, "o", "s", "2024-01-01 00:00:00").cache()
    by_path = {x["external_id"]: x for x in rows(once)}
    kept = by_path["db.shop.orders"]
    assert (kept["id"], kept["name"], kept["sensitivity_level"], kept["domain"]) == ("keep", "orders", "restricted", "sales")
    assert by_path["db.shop.gone"]["name"] == "gone" and by_path["db.shop"]["sensitivity_level"] == "unclassified"
    twice = c.upsert_assets(once, found, "o", "s", "2025-01-01 00:00:00")
    assert sorted(map(str, rows(twice))) == sorted(map(str, rows(once)))
    parents = {x["external_id"]: x["parent_id"] for x in rows(c.resolve_parents(once))}
    assert parents["db.shop.orders.status"] == "keep" and parents["db.shop"] is None


def test_information_schema(spark):
    tables = spark.createDataFrame([("shop", "orders", "BASE TABLE", 5)],
                                   "table_schema string, table_name string, table_type string, row_count bigint")
    columns = spark.createDataFrame([("shop", "orders", "id", "int", "NO", None, None, 1)],
        "table_schema string, table_name string, column_name string, data_type string, is_nullable string, "
        "column_default string, character_maximum_length int, ordinal_position int")
    got = {x["external_id"]: x for x in rows(c.discover_information_schema(tables, columns, "db"))}
    assert set(got) == {"db.shop", "db.shop.orders", "db.shop.orders.id"}
    assert got["db.shop.orders.id"]["metadata"] == {"data_type": "int", "is_nullable": "NO", "position": "1"}
    flat = {x["external_id"] for x in rows(c.discover_information_schema(tables, columns, "shop", has_schemas=False))}
    assert flat == {"shop", "shop.orders", "shop.orders.id"}


def test_cascade(spark):
    frame = spark.createDataFrame
    tables = {
        "data_sources": frame([("s1",), ("s2",)], "id string"),
        "assets": frame([("a", "s1"), ("b", "s2"), ("p", None)], "id string, source_id string"),
        "lineage_edges": frame([("a", "b", "p"), ("b", "p", "a"), ("b", "p", None)],
                               "source_id string, target_id string, transform_id string"),
        "classification_results": frame([("a",), ("b",)], "asset_id string"),
        "ai_models": frame([("m1", "s1"), ("m2", "s2")], "id string, source_id string"),
        "ai_model_versions": frame([("v1", "m1"), ("v2", "m2")], "id string, model_id string"),
        "monitoring_configs": frame([("c1", "v1"), ("c2", "v2")], "id string, model_version_id string"),
        "drift_alerts": frame([("v1", None), (None, "c1"), ("v2", "c2")], "model_version_id string, monitoring_config_id string"),
    }
    left, counts = c.drop_source_cascade(tables, "s1")
    assert {x["table"]: x["removed"] for x in rows(counts)} == {
        "data_sources": 1, "assets": 1, "lineage_edges": 2, "classification_results": 1, "ai_models": 1,
        "ai_model_versions": 1, "monitoring_configs": 1, "drift_alerts": 2}
    assert {x["id"] for x in rows(left["assets"])} == {"b", "p"}


ASSETS = ("id string, name string, external_id string, asset_type string, source_id string, sensitivity_level string, "
          "domain string, quality_score double, first_seen_at int, metadata map<string,string>, parent_id string")


def _assets(spark):
    return spark.createDataFrame(
        [("1", "Orders", "db.orders", "table", "s1", "internal", "sales", 95.0, 3, {"row_count": "10"}, None),
         ("2", "email", "db.orders.email", "column", "s1", "confidential", None, 70.0, 2, None, "1"),
         ("3", "ssn", "db.orders.ssn", "column", "s2", "restricted", "sales", 10.0, 1, None, "1"),
         ("4", "Raw", "db.raw", "table", "gone", "unclassified", "ops", None, 5, {"row_count": "n/a"}, None)], ASSETS)


def test_search_and_rollups(spark):
    a = _assets(spark)
    sources = spark.createDataFrame([("s1", "one"), ("s2", "two"), ("s3", "three")], "id string, name string")
    ids = lambda df: [x["id"] for x in df.collect()]
    assert ids(q.search_assets(a)) == ["4", "1", "2", "3"]
    assert ids(q.search_assets(a, "quality", q="ORDERS")) == ["1", "2", "3"]
    assert ids(q.search_assets(a, "name", limit=2, offset=1)) == ["4", "2"]
    assert ids(q.search_assets(a, has_pii=True)) == ["2", "3"]
    assert ids(q.search_assets(a, asset_type="column", domain="sales", source_id="s2", sensitivity="restricted")) == ["3"]
    assert rows(q.search_total(a, q="orders"))[0]["total"] == 3
    assert ids(q.asset_children(a, "1")) == ["2", "3"]
    assert [(x["source"], x["count"]) for x in q.count_by_source(a, sources).collect()] == [("one", 2), ("two", 1)]
    assert [(x["domain"], x["count"]) for x in q.top_domains(a).collect()] == [("sales", 2), ("ops", 1)]
    assert {x["bucket"]: x["count"] for x in rows(q.quality_buckets(a))} == {"90-100": 1, "70-89": 1, "50-69": 0, "<50": 1}
    assert rows(q.avg_quality(a))[0]["avg_quality"] == 58.3
    assert rows(q.avg_quality(a.where("id = '4'")))[0]["avg_quality"] is None
    assert rows(q.count_pii_columns(a))[0]["pii_columns"] == 2
    assert rows(q.total_governed_rows(a))[0]["total_rows"] == 10
    assert ids(q.recent_assets(a)) == ["4", "1"]
    facets = {(x["facet"], x["label"]): x["count"] for x in rows(q.facets(a, sources))}
    assert facets == {("source", "one"): 2, ("source", "two"): 1, ("asset_type", "table"): 2, ("asset_type", "column"): 2,
                      ("sensitivity", "internal"): 1, ("sensitivity", "confidential"): 1, ("sensitivity", "restricted"): 1,
                      ("sensitivity", "unclassified"): 1, ("domain", "sales"): 2, ("domain", "ops"): 1}


def test_best_finding_prefers_newest_on_tie(spark):
    findings = spark.createDataFrame(
        [("f1", "email", "PII", "x", 0.9, 1), ("f2", "email", "PCI", "x", 0.9, 2), ("f3", "email", "PHI", "x", 0.5, 3)],
        "id string, column string, category string, sensitivity_level string, confidence double, detected_at int")
    assert rows(q.best_finding_per_column(findings))[0]["category"] == "PCI"


def test_sync_models_and_cards(spark):
    shape = ("id string, source_id string, external_id string, name string, asset_type string, parent_id string, "
             "metadata map<string,string>, tags map<string,string>, metrics map<string,double>, params map<string,string>")
    assets = spark.createDataFrame(
        [("a", "s", "reg/m", "churn", "ml_model", None, {"description": "d"}, {"framework": "xgb"}, {}, {}),
         ("b", "s", "reg/m/7", "v7", "ml_model_version", "a", {"version": ""}, {}, {"auc": 0.9}, {}),
         ("c", "s", "reg/m/8", "v8", "ml_model_version", "a", {"version": "8", "stage": "prod"}, {}, {}, {}),
         ("d", "s", "reg/x/1", "lost", "ml_model_version", "zzz", {}, {}, {}, {})], shape)
    models = spark.createDataFrame([("m", "o", "reg/m", "s0", "old", "before", None, "clf")],
        "id string, org_id string, external_id string, source_id string, name string, description string, framework string, model_type string")
    versions = spark.createDataFrame([("v", "m", "7", "e", {"auc": 0.1}, {"k": "1"}, "staging")],
        "id string, model_id string, version_number string, external_version_id string, metrics map<string,double>, "
        "hyperparameters map<string,string>, stage string")
    new_models, new_versions, counts = r.sync_models(assets, models, versions, "o", "s")
    m = rows(new_models)[0]
    assert (m["id"], m["source_id"], m["name"], m["description"], m["framework"], m["model_type"]) == (
        "m", "s", "churn", "d", "xgb", "clf")
    v = {x["version_number"]: x for x in rows(new_versions)}
    assert set(v) == {"7", "8"} and v["7"]["metrics"] == {"auc": 0.9} and v["7"]["hyperparameters"] == {"k": "1"}
    assert v["7"]["stage"] == "staging" and v["8"]["stage"] == "prod" and v["8"]["metrics"] == {}
    assert {x["measure"]: x["n"] for x in rows(counts)} == {
        "models_synced": 0, "versions_synced": 1, "models_total": 1, "versions_total": 3}
    again = r.sync_models(assets, new_models, new_versions, "o", "s")[2]
    assert {x["n"] for x in rows(again) if x["measure"].endswith("synced")} == {0}


def test_model_lineage_unknown_assets(spark):
    versions = spark.createDataFrame([("v", "m", "1", "dev", ["a", "zz"]), ("w", "m", "2", "dev", None)],
        "id string, model_id string, version_number string, stage string, training_dataset_ids array<string>")
    assets = spark.createDataFrame([("a", "orders", "table")], "id string, name string, asset_type string")
    got = {(x["version_id"], x["dataset_id"]): x["dataset_name"] for x in rows(r.model_lineage(versions, assets))}
    assert got == {("v", "a"): "orders", ("v", "zz"): "(unknown asset)", ("w", None): None}
