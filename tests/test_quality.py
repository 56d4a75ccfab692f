from conftest import rows
from shop import shop_tables

from tallyward.operators.quality import (
    QualityRule,
    evaluate_rules,
    latest_runs,
    profile_columns,
    quality_results,
    quality_run,
    rules_from_frame,
    suggest_rules,
)


def test_shop_faults(spark):
    shop = shop_tables(spark)
    rules = {
        "customers": [QualityRule("a", "not_null", "email"), QualityRule("b", "unique", "email")],
        "orders": [
            QualityRule("c", "range", "total_amount", min_value=0),
            QualityRule("d", "not_null", "status"),
        ],
    }
    tables = {k: shop[k] for k in rules}
    got = {r["rule_id"]: r for r in rows(quality_results(tables, rules))}
    assert {k: (v["records_failed"], v["records_evaluated"], v["status"]) for k, v in got.items()} == {
        "a": (11, 200, "failed"),
        "b": (4, 200, "failed"),
        "c": (26, 600, "failed"),
        "d": (31, 600, "failed"),
    }
    assert got["a"]["sample_failures"] == [None] * 10
    assert got["b"]["sample_failures"] == ["dupe@example.com"] * 4
    assert got["c"]["sample_failures"] == ["-25.00"] * 10
    assert abs(got["b"]["failure_percentage"] - 2.0) < 1e-9
    scores = {r["asset"]: r for r in rows(quality_run({**tables, "products": shop["products"]}, rules))}
    assert scores["customers"]["score"] == 0.0 and scores["orders"]["score"] == 0.0
    assert scores["products"]["score"] is None and scores["products"]["total_rules"] == 0


def test_rule_kinds_and_errors(spark):
    df = spark.createDataFrame(
        [("a1", 1, "x"), ("b2", 5, "y"), (None, None, None), ("c", 9, "z")], "code string, n int, s string"
    )
    rules = [
        QualityRule("regex", "regex", "code", pattern="[0-9]"),
        QualityRule("any", "regex", "code"),
        QualityRule("range", "range", "n", min_value=1, max_value=5),
        QualityRule("set", "in_set", "s", values=("x", "y")),
        QualityRule("emptyset", "in_set", "s"),
        QualityRule("exists", "column_exists", "n"),
        QualityRule("odd", "freshness", "n"),
        QualityRule("gone", "mystery", "nope"),
        QualityRule("missing", "not_null", "nope"),
        QualityRule("nobounds", "range", "n"),
        QualityRule("textrange", "range", "s", min_value=1),
        QualityRule("off", "not_null", "n", active=False),
    ]
    got = {r["rule_id"]: r for r in rows(evaluate_rules(df, rules, strict_parity=True))}
    assert "off" not in got
    assert (got["regex"]["records_failed"], got["regex"]["sample_failures"]) == (1, ["c"])
    assert got["any"]["status"] == "passed"
    assert (got["range"]["records_failed"], got["range"]["sample_failures"]) == (1, ["9"])
    assert got["set"]["sample_failures"] == ["z"] and got["emptyset"]["records_failed"] == 3
    assert got["exists"]["status"] == "passed" and got["exists"]["records_evaluated"] == 0
    assert got["odd"]["status"] == "passed" and got["gone"]["status"] == "failed"
    for bad in ("missing", "nobounds", "textrange"):
        assert got[bad]["status"] == "error" and got[bad]["records_evaluated"] == 0
    empty = rows(evaluate_rules(df.where("false"), rules[:3]))
    assert {r["status"] for r in empty} == {"error"}


def test_freshness(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-10 00:00:00' AS ts")
    fresh = [QualityRule("f", "freshness", "ts", max_age="3 days")]
    assert rows(evaluate_rules(df, fresh, now="2024-01-12"))[0]["status"] == "passed"
    assert rows(evaluate_rules(df, fresh, now="2024-01-14"))[0]["status"] == "failed"


def test_unique_samples_are_bounded(spark):
    df = spark.range(5000).selectExpr("id % 3 AS k", "id AS u")
    got = {r["rule_id"]: r for r in rows(
        evaluate_rules(df, [QualityRule("k", "unique", "k"), QualityRule("u", "unique", "u")])
    )}
    assert got["k"]["records_failed"] == 5000 and got["k"]["sample_failures"] == ["0"] * 10
    assert got["u"]["status"] == "passed"


def test_profile_and_suggestions(spark):
    shop = shop_tables(spark)
    profile = profile_columns(shop["customers"])
    by_column = {r["column"]: r for r in rows(profile)}
    assert by_column["email"]["null_count"] == 11 and by_column["email"]["distinct_count"] == 186
    assert by_column["id"]["is_numeric"] and by_column["id"]["distinct_count"] == 200
    approx = {r["column"]: r for r in rows(profile_columns(shop["customers"], approximate=True))}
    assert approx["email"]["non_null"] == 189
    existing = spark.createDataFrame([("not_null", "id")], "rule_type string, column string")
    got = {(r["rule_type"], r["column"]) for r in rows(suggest_rules(profile, existing))}
    assert ("unique", "id") in got and ("not_null", "id") not in got
    assert ("regex", "email") in got and ("unique", "email") not in got and ("not_null", "email") not in got
    orders = {(r["rule_type"], r["column"]) for r in rows(suggest_rules(profile_columns(shop["orders"])))}
    assert ("range", "total_amount") in orders and ("range", "customer_id") not in orders


def test_rules_from_frame_and_latest_runs(spark):
    frame = spark.createDataFrame(
        [("r", "in_set", "s", ["a"])], "rule_id string, rule_type string, column string, values array<string>"
    )
    assert rules_from_frame(frame) == [QualityRule("r", "in_set", "s", values=("a",))]
    runs = spark.createDataFrame([("a", i, f"r{i}") for i in range(30)], "asset string, run_at int, run_id string")
    got = rows(latest_runs(runs, 3), "run_at")
    assert [r["run_at"] for r in got] == [27, 28, 29]
