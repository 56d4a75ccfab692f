"""Cases without work, refused pages, pattern dialects, repeated keys, and removal of all dependents."""

import pytest
from conftest import rows

from tallyward.operators import catalog, classify, drift, pii, quality, risk, rollups
from tallyward.operators.classify import ClassificationRule
from tallyward.sources import datasets


def test_nothing_to_check(spark):
    tables = {"a": spark.range(3), "b": spark.range(2)}
    got = rows(quality.quality_run(tables, {}), "asset")
    assert [(r["asset"], r["score"], r["total_rules"], r["failed"]) for r in got] == [("a", None, 0, 0), ("b", None, 0, 0)]
    configs = [drift.MonitorConfig("c1", "m1", None, "x"), drift.MonitorConfig("c2", "m1", "gone", "x")]

    def load(name):
        raise FileNotFoundError(name)

    alerts, summary = drift.monitor_sweep(configs, load)
    assert alerts.count() == 0 and rows(summary) == [{"active_configs": 2, "checked": 0, "alerts_raised": 0, "skipped": 2}]


def test_larger_pages_are_refused(spark):
    frame = spark.createDataFrame([("a", "b", "c", "d")], "id string, name string, action string, occurred_at string")
    for call in (
        lambda: datasets.sample_rows(frame, 101), lambda: rollups.search_assets(frame, limit=501), lambda: risk.audit_search(frame, limit=2001),
    ):
        with pytest.raises(ValueError, match="at most"):
            call()


def test_pattern_dialects(spark):
    frame = spark.createDataFrame([("x77x77", "abc")], "a string, b string")
    rules = [
        ClassificationRule("named", "c", "internal", "regex", r"(?P<x>7)(?P<two_7>7).(?P=x)(?P=two_7)"),
        ClassificationRule("posix", "c", "internal", "regex", r"^\p{Alpha}+$"), ClassificationRule("bad", "c", "internal", "regex", "(7"),
    ]
    got = {(r["column"], r["rule"]) for r in rows(classify.classify_columns(frame, rules))}
    assert ("a", "named") in got and ("b", "posix") in got and all(rule != "bad" for _, rule in got)


def test_phone_recognizer(spark):
    values = {"(555) 010-2000": 1, "555.010.2000": 1, "+49 30 1234567": 1, "555-010-2000": 1, "order 123456789": 0, "2024-05-17 10": 0,
              "123-45-6789": 0, "12.345.678": 0, "192.168.100.100": 0}
    for text, want in values.items():
        found = rows(pii.detect_pii_values(spark.createDataFrame([(text,)], "v string")))
        assert sum(r["entity"] == "PHONE_NUMBER" for r in found) == want, text


def test_results_of_removed_runs_go(spark):
    make = spark.createDataFrame
    tables = {
        "assets": make([("a", "s1"), ("b", "s2")], "id string, source_id string"),
        "quality_check_runs": make([("r1", "a"), ("r2", "b")], "id string, asset_id string"),
        "quality_check_results": make([("x", "r1", "q"), ("y", "r2", "q")], "id string, run_id string, rule_id string"),
    }
    left, removed = catalog.drop_source_cascade(tables, "s1")
    assert {r["table"]: r["removed"] for r in rows(removed)} == {"assets": 1, "quality_check_runs": 1, "quality_check_results": 1}
    assert [r["id"] for r in rows(left["quality_check_results"])] == ["y"]


def test_latest_findings_stay_in_order(spark):
    found = spark.createDataFrame([(f"f{n}", f"a{n % 3}", n) for n in range(40)], "id string, asset_id string, detected_at int")
    assets = spark.createDataFrame([(f"a{n}", f"col{n}") for n in range(3)], "id string, name string")
    assert [r["detected_at"] for r in classify.latest_findings(found, assets, 9).collect()] == list(range(39, 30, -1))


def test_scratch_is_removed(spark, tmp_path):
    from pathlib import Path

    from tallyward import session

    held = dict(session._scratch)
    session._scratch.clear()
    frame = session.written(spark.range(5), "kept")
    paths = list(session._scratch)
    assert frame.count() == 5 and len(paths) == 1 and Path(paths[0]).exists()
    assert session.clear_scratch() == 1 and not Path(paths[0]).exists() and session.clear_scratch() == 0
    session._scratch.update(held)
