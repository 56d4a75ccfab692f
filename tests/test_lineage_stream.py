"""Lineage events as a stream: the same tables for any cut into batches, and work that follows what is new."""

import json
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_lineage import EVENT

from tallyward.operators import openlineage
from tallyward.sources.files import stream_lineage_events
from tallyward.streaming import openlineage as ol

ASSETS = [("o1", "orders", "db.shop.orders", "table"), ("o2", "total", "db.shop.orders.total", "column"), ("x1", "x", "lake.x", "table")]
ASSET_KIND = "id string, name string, external_id string, asset_type string"


def events():
    """Names that resolve, names under several namespaces, names that look like earlier placeholders, repeated runs."""
    out = []
    for n in range(24):
        name = ["orders", "raw.items", "items", "w.raw.items", "lake.x", "x"][n % 6]
        fields = {"total": {"inputFields": [{"name": name, "field": ["total", "qty"][n % 2]}, {"name": "only.columns", "field": "f"}]}}
        out.append({
            "eventType": "COMPLETE", "run": {"runId": str(n)}, "job": {"namespace": ["etl", ""][n % 2], "name": f"load_{n % 4}"},
            "inputs": [{"namespace": f"ns{9 - n % 7}", "name": name}, {"namespace": "", "name": f"part_{n % 5}"}, {"name": None}],
            "outputs": [{"namespace": f"ns{n % 3}", "name": f"mart.t{n % 3}", "facets": {"columnLineage": {"fields": fields}}}],
        })
    return [json.dumps(e) for e in [*out, *out[:7], {"eventType": "START"}, {"job": {"name": "idle"}, "inputs": [], "outputs": []}]]


def same(df):
    return sorted(map(str, rows(df.select(sorted(df.columns)))))


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(e, n) for n, e in enumerate(events())], "value string, n int")


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(ASSETS, ASSET_KIND)


def ingest(spark, lines, catalog, tmp_path, batches):
    store, inbox = str(tmp_path / f"store{batches}"), str(tmp_path / f"inbox{batches}")
    ol.seed_catalog(catalog, store, buckets=4)
    lines.repartitionByRange(batches, "n").select("value").write.text(inbox)
    query = ol.stream_openlineage(stream_lineage_events(spark, inbox, files_per_batch=1), store, f"{store}-state")
    query.awaitTermination()
    return store, query


def test_any_cut_into_batches_gives_the_tables_of_one_run(spark, lines, catalog, tmp_path):
    parsed = openlineage.parse_openlineage(lines.select("value"))
    nodes, edges = openlineage.ingest(parsed, catalog)
    wanted = same(nodes), same(edges)
    assert len(wanted[0]) > 10 and len(wanted[1]) > 20
    for batches in (1, 3, 7):
        store, _ = ingest(spark, lines, catalog, tmp_path, batches)
        assert (same(ol.read_placeholders(spark, store)), same(ol.read_edges(spark, store))) == wanted
    target = f"{store}-compacted"
    ol.compact(spark, store, target)
    assert (same(ol.read_placeholders(spark, target)), same(ol.read_edges(spark, target))) == wanted
    assert spark.read.parquet(f"{target}/facts").select("batch").distinct().count() == 1


def test_known_facts_cost_nothing(spark, lines, catalog, tmp_path):
    """Events seen before leave empty batches, no index is read for them, and no scratch is left behind."""
    store, _ = ingest(spark, lines, catalog, tmp_path, 1)
    before = spark.read.parquet(f"{store}/facts").count()
    lines.select("value").write.mode("append").text(str(tmp_path / "inbox1"))
    query = ol.stream_openlineage(stream_lineage_events(spark, str(tmp_path / "inbox1")), store, f"{store}-state")
    query.awaitTermination()
    assert spark.read.parquet(f"{store}/facts").count() == before
    assert sum(p["numInputRows"] for p in query.recentProgress) >= len(events())
    assert {p.name for p in (tmp_path / "store1").iterdir()} == {"catalog", "index", "facts", "answers"}


def test_a_batch_reads_the_buckets_of_its_names(spark, catalog, tmp_path):
    many = catalog.unionByName(spark.range(2000).selectExpr("concat('m', id) AS id", "concat('n', id) AS name", "concat('s.n', id) AS external_id", "'table' AS asset_type"))
    store = str(tmp_path / "store")
    ol.seed_catalog(many, store, buckets=64)
    facts = spark.createDataFrame([("dataset", None, None, "s.n7", None, "a", None, None)], ", ".join(f"{c} string" for c in openlineage.FACT_COLUMNS))
    found = ol._answers(spark, facts, store)
    assert [(r["ref"], r["asset_id"]) for r in rows(found)] == [("s.n7", "m7")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert scans and all(len(re.search(r"bucket#\d+ (?:IN \(|= )([\d,]+)", s)[1].split(",")) <= 4 for s in scans)  # of 64


def test_a_new_checkpoint_adds_beside_earlier_streams(spark, catalog, tmp_path):
    store = str(tmp_path / "store")
    ol.seed_catalog(catalog, store)
    for n, event in enumerate((EVENT, EVENT, EVENT.replace("orders", "returns"))):
        inbox = str(tmp_path / f"in{n}")
        spark.createDataFrame([(event.replace("\n", ""),)], "value string").write.text(inbox)
        ol.stream_openlineage(stream_lineage_events(spark, inbox), store, str(tmp_path / f"state{n}")).awaitTermination()
        if n == 0:
            first = same(ol.read_edges(spark, store))
            assert len(first) == 3 and ol.read_placeholders(spark, store).count() == 5
        if n == 1:
            assert same(ol.read_edges(spark, store)) == first
    assert ol.read_edges(spark, store).count() > 3
    assert spark.read.parquet(f"{store}/facts").where(F.col("run") != "seed").select("run").distinct().count() == 3
