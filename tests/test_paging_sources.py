"""Paging by keys, n-th rows, listings, script corpora, planned database scans, known forests."""

import datetime
import math
import os
import random
import sqlite3

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyward.functions.selection import nth_row
from tallyward.operators import explain, rollups
from tallyward.sources import jdbc, listing


@pytest.mark.parametrize("sort", ["recent", "name", "quality"])
def test_pages_by_key_are_those_by_offset(spark, tmp_path, sort):
    rng = random.Random(5)
    data = [(f"a{n:03}", rng.choice([None, "x", "y", "Z"]), rng.choice([None, 1.0, 2.5, 9.0]),
             rng.choice([None, datetime.datetime(2024, 1, d + 1)]) if (d := rng.randrange(4)) < 9 else None, "table") for n in range(70)]
    assets = spark.createDataFrame(data, "id string, name string, quality_score double, first_seen_at timestamp_ntz, asset_type string")
    path = str(tmp_path / "layout")
    rollups.write_search_layout(assets, path, sort)
    stored = spark.read.parquet(path)
    after, seen = None, []
    while True:
        page = rollups.search_assets(stored, sort, 16, after=after, asset_type="table")
        seen.append([r["id"] for r in page.collect()])
        after = rollups.page_end(page, sort)
        if after is None:
            break
    assert seen == [[r["id"] for r in rollups.search_assets(assets, sort, 16, offset=16 * n).collect()] for n in range(6)] and seen[-1] == []
    assert sum(seen, []) == [r["id"] for r in rollups.search_assets(assets, sort, 100).collect()]


def test_a_deep_page_reads_part_of_the_layout(spark, tmp_path):
    path = str(tmp_path / "layout")
    spark.range(20_000).selectExpr("string(id) AS id", "concat('n', lpad(id, 6, '0')) AS name", "'table' AS asset_type").write.parquet(f"{path}-in")
    rollups.write_search_layout(spark.read.parquet(f"{path}-in"), path, "name")
    page = rollups.search_assets(spark.read.parquet(path), "name", 10, after=("n019000", "19000"))
    assert [r["name"] for r in page.collect()] == [f"n{n:06}" for n in range(19001, 19011)]
    assert "PushedFilters: [Or(GreaterThan(name,n019000)" in page._jdf.queryExecution().executedPlan().toString()


def test_nth_row(spark):
    rng = random.Random(1)
    data = [(rng.choice([None, 1.0, 2.0, 2.0, 2.0, float(rng.randrange(50))]), float(rng.randrange(9)), n) for n in range(900)]
    frame = spark.createDataFrame(data, "a double, b double, n int").repartition(4)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))
    for index in (0, 1, 150, 449, 450, 620, 898, 899):
        got = nth_row(frame, ["a", "b"], index, cuts=4, small=5)
        assert (got["a"], got["b"]) == order[index][:2]
    assert nth_row(frame, ["a", "b"], 900, 4, 5) is None and nth_row(frame, ["a"], -1) is None and nth_row(frame.limit(0), ["a"], 0) is None
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,), (-math.inf,)] * 3, "a double")
    assert [nth_row(odd, ["a"], n, 2, 1)["a"] for n in (6, 9)] == [1.0, math.inf] and math.isnan(nth_row(odd, ["a"], 12, 2, 1)["a"])


def test_listing(spark, tmp_path):
    wanted = {}
    for n in range(30):
        folder = tmp_path / f"d{n % 7}" / f"e{n % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{n}.txt").write_bytes(b"x" * n)
        wanted[str(folder / f"f{n}.txt")] = n
    (tmp_path / "top.sql").write_text("select 1")
    wanted[str(tmp_path / "top.sql")] = 8
    os.mkdir(tmp_path / "empty")
    for folders in (1, 5, 100):
        got = rows(listing.listed(spark, str(tmp_path), folders))
        assert {r["path"]: r["size_bytes"] for r in got} == wanted and len(got) == len(wanted)
    assert listing.listed(spark, tmp_path.as_uri()).where("name = 'top.sql'").count() == 1
    assert listing.listed(spark, str(tmp_path / "empty")).count() == 0


def test_planned_scan_parts_a_table():
    """The probe and its conditions on a database of this process: every row once, parts of equal size, hot value apart."""
    db = sqlite3.connect(":memory:")
    db.execute('CREATE TABLE orders ("the key" INTEGER)')
    values = [7] * 400 + list(range(1000, 1600)) + [None] * 5
    db.executemany("INSERT INTO orders VALUES (?)", [(v,) for v in values])
    probe = jdbc.probe_query("postgresql", "db.main.orders", "the key", 10)
    assert '"main"."orders"' in probe
    lows = [low for _, low in sorted(db.execute(probe).fetchall())]
    parts = jdbc.depth_predicates("postgresql", "the key", lows)
    counts = [db.execute(f"SELECT count(*) FROM orders WHERE {p}").fetchone()[0] for p in parts]
    assert sum(counts) == len(values) and counts[0] == 405 and max(counts[1:]) <= 101 and len(parts) == 7
    assert jdbc.depth_predicates("mysql", "k", ["a'b", "a'b", "c"]) == ["`k` < 'c' OR `k` IS NULL", "`k` >= 'c'"]
    assert jdbc.depth_predicates("mssql", "k", [None, 3]) == ["1 = 1"] == jdbc.depth_predicates("mssql", "k", [])
    with pytest.raises(TypeError):
        jdbc.depth_predicates("mssql", "k", [False, True])


def test_bigquery_options():
    options = jdbc.bigquery_options({"project_id": "p", "service_account_json": "{}"}, "p.d.t", 8)
    assert options == {"table": "p.d.t", "parentProject": "p", "maxParallelism": "8", "credentials": "e30="}
    with pytest.raises(ValueError):
        jdbc.bigquery_options({"project_id": "p"}, "d.t")


def test_attributions_of_a_known_forest(spark):
    """One stump: the whole difference to the mean row belongs to its feature, whatever the other does."""
    frame = spark.createDataFrame([(0.0, 5.0), (1.0, 6.0), (1.0, 7.0)], "a double, b double")
    leaves = [({0: (-math.inf, 0.7)}, [2.0]), ({0: (0.7, math.inf)}, [5.0])]
    got = rows(explain.attributions(frame, ("a", "b"), leaves, (0.66, 6.0)))
    assert sorted(r["a0"] for r in got) == [0.0, 3.0, 3.0] and {r["a1"] for r in got} == {0.0}
    shares = {r["feature"]: r["importance"] for r in rows(explain.scaled_importance(explain.attributions(frame, ("a", "b"), leaves, (0.66, 6.0)), ("a", "b")))}
    assert shares == {"a": 1.0, "b": 0.0} and F is not None
