import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyward.operators import drift as d
from tallyward.operators import fairness as f


def test_fairness_records(spark):
    df = spark.createDataFrame(
        [("M", "1", "1"), ("M", "0", "1"), ("M", "1", "1"), ("F", "1", "0"), ("F", "0", "0"), ("F", "1", "0")],
        "gender string, label string, prediction string")
    metrics, verdict = f.bias_test(df, "gender")
    got = {r["group"]: r for r in rows(metrics)}
    assert got["M"]["selection_rate"] == 1.0 and got["M"]["true_positive_rate"] == 1.0
    assert {r["group"]: r["precision"] for r in rows(f.predictive_parity(metrics))} == {"M": 0.6667, "F": 0.0}
    v = rows(verdict)[0]
    assert (v["demographic_parity_gap"], v["equal_opportunity_gap"], v["verdict"]) == (1.0, 1.0, "fail")
    assert v["summary"] == "Verdict=fail (DP gap 1.0, EO gap 1.0)"
    with pytest.raises(ValueError, match="age"):
        f.bias_test(df, "age")


def test_null_group_and_thresholds(spark):
    df = spark.createDataFrame([(None, True, 1), ("a", False, None)], "g string, label boolean, prediction int")
    got = {r["group"]: r["selection_rate"] for r in rows(f.group_metrics(df, ["g"]))}
    assert got == {"None": 1.0, "a": 0.0}
    assert rows(df.select(f.binarize(df, "label", "True").alias("b"))) == [{"b": 1}, {"b": 0}]
    gaps = spark.createDataFrame([(0.2, 0.0), (0.2001, 0.0), (0.1, 0.1), (0.0, 0.11)], "a double, b double")
    assert [r[0] for r in gaps.select(f.bias_verdict(F.col("a"), F.col("b"))).collect()] == [
        "warning", "fail", "pass", "warning"]


def _pair(spark, base, current):
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    return frame(base), frame(current)


CASES = [
    (range(1, 41), range(20, 60), 0.475, 5.54, 0.0002, "critical"),
    (range(0, 60), range(25, 85), 0.4167, 5.2924, 0.0001, "critical"),
    ([i % 7 for i in range(60)], [i % 7 for i in range(60)], 0.0, 0.0, 1.0, None),
    ([40 + i % 30 for i in range(100)], [70 + i % 40 for i in range(100)], 1.0, 12.6861, 0.0, "critical"),
    ([30 + i % 25 for i in range(100)], [31 + i % 25 for i in range(100)], 0.04, 0.0277, 1.0, None),
]


def test_drift_golden_values(spark):
    sides = None
    for i, (base, current, *_) in enumerate(CASES):
        part = d.numeric_sides(*_pair(spark, base, current), ["x"], dataset=str(i))
        sides = part if sides is None else sides.unionByName(part)
    got = {int(r["dataset"]): r for r in rows(d.drift_check(sides))}
    for i, (_, _, distance, index, p, severity) in enumerate(CASES):
        assert abs(got[i]["ks_distance"] - distance) < 1e-9, i
        assert abs(got[i]["psi"] - index) < 1e-9, i
        assert abs(got[i]["p_value"] - p) < 1.1e-4, i
        assert got[i]["severity"] == severity and got[i]["drift"] == (severity is not None)
    alerts = rows(d.drift_alert(d.drift_check(sides), "v1", "2024-01-01"))
    assert len(alerts) == 3 and alerts[0]["affected_features"] == ["x"]


def test_ks_brute_force_symmetric_and_skewed(spark):
    rng = random.Random(7)
    base = [5.0] * 400 + [rng.gauss(0, 3) for _ in range(500)]
    current = [5.0] * 700 + [rng.gauss(1, 2) for _ in range(300)]
    points = sorted(set(base + current))
    brute = max(abs(sum(b <= p for b in base) / len(base) - sum(c <= p for c in current) / len(current)) for p in points)
    left, right = _pair(spark, base, current)
    for buckets in (1, 16, 64):
        one = rows(d.ks_test(d.numeric_sides(left, right, ["x"]), buckets))[0]
        assert abs(one["distance"] - brute) < 1e-12
    other = rows(d.ks_test(d.numeric_sides(right, left, ["x"])))[0]
    assert abs(other["distance"] - brute) < 1e-12
    same = rows(d.psi(d.numeric_sides(left, left, ["x"])))[0]
    assert same["psi"] == 0.0


def test_empty_and_constant_sides(spark):
    left, right = _pair(spark, [1, 1, 1], [2, 3])
    assert rows(d.psi(d.numeric_sides(left, right, ["x"])))[0]["psi"] == 0.0
    none = left.where("false")
    assert rows(d.psi(d.numeric_sides(none, right, ["x"])))[0]["psi"] == 0.0
    assert rows(d.ks_test(d.numeric_sides(none, right, ["x"]))) == []


def _mixed(spark, shift):
    return spark.range(200).selectExpr(
        f"cast(id + {shift} as double) AS amount", f"cast((id + {shift}) % 3 as int) AS tier",
        f"if(id % 4 < {1 if shift else 2}, 'y', 'n') AS flag", "concat('k', id % 5) AS kind", "current_date() AS day")


def test_dataset_drift_and_sweep(spark):
    reference, current = _mixed(spark, 0), _mixed(spark, 150)
    columns = {r["column"]: r for r in rows(d.column_drift(reference, current))}
    assert {c: r["test"] for c, r in columns.items()} == {
        "amount": "ks", "tier": "chisquare", "flag": "z", "kind": "chisquare"}
    assert {c for c, r in columns.items() if r["drift_detected"]} == {"amount", "flag"}
    verdict = d.dataset_drift(d.column_drift(reference, current))
    row = rows(verdict)[0]
    assert (row["dataset_drift"], row["share_drifted"], row["affected_features"]) == (True, 0.5, ["amount", "flag"])
    assert rows(d.dataset_drift_alert(verdict, "v"))[0]["severity"] == "warning"
    tables = {"a": reference, "b": current}
    configs = [d.MonitorConfig("1", "v1", "a", "b"), d.MonitorConfig("2", "v2", "a", "a"),
               d.MonitorConfig("3", "v3", "a", None), d.MonitorConfig("4", "v4", "a", "gone"),
               d.MonitorConfig("5", "v5", "a", "b", is_active=False), d.MonitorConfig("6", "v6", "a", "b")]
    alerts, summary = d.monitor_sweep(configs, lambda name: tables[name])
    assert {(r["config_id"], r["severity"]) for r in rows(alerts)} == {("1", "critical"), ("6", "critical")}
    assert rows(summary) == [{"active_configs": 5, "checked": 3, "alerts_raised": 2, "skipped": 2}]
    reasons = {r["config_id"]: r["reason"] for r in rows(d.skipped_configs(spark, configs, lambda name: tables[name]))}
    assert set(reasons) == {"3", "4"} and reasons["4"] == "gone: KeyError: 'gone'"


def test_new_category_is_certain_drift(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)] * 10, "k string")
    right = left.union(spark.createDataFrame([("d",)], "k string"))
    assert rows(d.categorical_drift(left, right, ["k"]))[0]["p_value"] == 0.0
