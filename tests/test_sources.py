import pytest
from conftest import rows

from tallyward.sources import datasets, files, jdbc

CONFIG = {"host": "h", "database": "db", "username": "u", "password": "p"}


def test_files(spark, tmp_path):
    df = spark.range(3).selectExpr("id", "concat('v', id) AS v")
    for fmt in ("parquet", "json"):
        df.write.format(fmt).save(str(tmp_path / f"t.{fmt}"))
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    for fmt in ("parquet", "json", "csv"):
        got = files.scan_files(spark, str(tmp_path / f"t.{fmt}"))
        assert got.count() == 3 and {n for n, _ in files.file_columns(got)} == {"id", "v"}
    assert files.scan_files(spark, str(tmp_path / "t.csv"), schema="id string, v string").schema["id"].dataType.simpleString() == "string"
    with pytest.raises(ValueError):
        files.scan_files(spark, "x.avro")
    listed = files.list_files(spark, str(tmp_path / "t.parquet"))
    assert "content" not in listed.columns and {r["file_format"] for r in rows(listed)} == {"parquet"}


def test_scripts(spark, tmp_path):
    root = tmp_path / "etl"
    (root / "sub dir").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "a.sql").write_text("select 1;\nselect 2;")
    (root / "sub dir" / "b.py").write_text("x = 1")
    (root / "c.txt").write_text("no")
    (root / ".git" / "d.sql").write_text("no")
    got = {r["path"]: r for r in rows(files.scan_scripts(spark, str(root)))}
    assert set(got) == {"a.sql", "sub dir/b.py"}
    assert got["a.sql"]["content"] == "select 1;\nselect 2;" and got["a.sql"]["external_id"] == "repo://etl/a.sql"


def test_lineage_events(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"eventType":"START","job":{"name":"j"},"inputs":[{"name":"a"}],"outputs":[]}\n')
    event = rows(files.read_lineage_events(spark, str(tmp_path)))[0]
    assert event["job"]["name"] == "j" and event["inputs"][0]["name"] == "a"


def test_jdbc_options():
    o = jdbc.scan_options("postgresql", CONFIG, 'db.sh"op.orders', "id", (0, 100), 8)
    assert o["url"] == "jdbc:postgresql://h:5432/db" and o["dbtable"] == '"sh""op"."orders"'
    assert (o["partitionColumn"], o["numPartitions"], o["upperBound"]) == ("id", "8", "100")
    assert jdbc.quoted_table("mysql", "db.orders") == "`orders`"
    with pytest.raises(ValueError):
        jdbc.quoted_table("postgresql", "orders")
    with pytest.raises(ValueError):
        jdbc.scan_options("mssql", CONFIG, "db.s.t", "id")
    counted = jdbc.discovery_queries("postgresql", "db")
    assert "pg_stat_user_tables" in counted["tables"] and "n_live_tup" in counted["tables"] and "AS row_count" in counted["tables"]
    q = jdbc.discovery_queries("mysql", "db")
    assert "table_schema = 'db'" in q["columns"] and "pg_catalog" in jdbc.discovery_queries("redshift", "d")["tables"]


def test_datasets(spark, tmp_path):
    assets = spark.createDataFrame([("t", "db.s.orders", "table"), ("c", "db.s.orders.id", "column")],
                                   "id string, external_id string, asset_type string")
    seen = []

    def resolve(path):
        seen.append(path)
        return spark.range(5)

    assert datasets.load_dataset(assets, "c", resolve).count() == 5
    assert datasets.load_dataset(assets, "t", resolve, limit=2).count() == 2
    assert seen == ["db.s.orders", "db.s.orders"]
    with pytest.raises(ValueError):
        datasets.load_dataset(assets, "zz", resolve)
    odd = spark.createDataFrame([("1.5",), ("",), (None,), ("x",), ("2",)], "v string")
    assert sorted(r["value"] for r in rows(datasets.numeric_series(odd, "v"))) == [1.5, 2.0]
    sample = datasets.sample_rows(spark.range(500), 100, ["id"])
    assert sample.count() == 100 and sample.first()["id"] == "0"
    out = str(tmp_path / "results")
    for day in ("2024-01-01", "2024-01-02"):
        datasets.write_results(spark.range(2), out, day)
    assert spark.read.parquet(out).groupBy("run_date").count().count() == 2
