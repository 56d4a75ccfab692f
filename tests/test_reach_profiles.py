"""Reach of many starts, stored profiles and repeated texts."""

import random

from conftest import rows
from pyspark.sql import functions as F

from tallyward.operators import graph, profiles, quality
from tallyward.operators.quality import QualityRule


def brute_reach(edges, starts):
    out = set()
    for start in starts:
        seen, frontier, depth = {start: 0}, [start], 0
        while frontier:
            depth += 1
            frontier = sorted({t for s, t in edges if s in frontier} - seen.keys())
            seen |= dict.fromkeys(frontier, depth)
        out |= {(start, node, d) for node, d in seen.items()}
    return out


def test_reach_of_many_starts(spark):
    """Cycles, parallel edges, self loops, nulls, and more starts than a word has bits."""
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(110)] + [("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("d", "d")]
    frame = spark.createDataFrame([*edges, (None, "a"), ("a", None)], "source_id string, target_id string").repartition(3)
    starts = {s for s, _ in edges}
    assert len(starts) > 64
    got = {(r["start"], r["id"], r["depth"]) for r in rows(graph.reach(frame))}
    assert got == brute_reach(edges, starts)
    upward = graph.reach(frame, spark.createDataFrame([("c",), ("d",), ("nowhere",)], "x string"), "up", max_depth=1)
    assert {(r["start"], r["id"], r["depth"]) for r in rows(upward)} == {
        ("c", "c", 0), ("c", "b", 1), ("d", "d", 0), ("nowhere", "nowhere", 0)} | {("d", s, 1) for s, t in edges if t == "d" and s != "d"}
    report = {r["start"]: (r["reached"], r["deepest"]) for r in rows(graph.impact_of_all(frame))}
    assert report["a"] == (2, 2) and report["d"] == (0, 0) and set(report) == starts
    assert graph.reach(frame.limit(0)).count() == 0


def test_parts_are_profiled_alone_and_merged(spark, tmp_path):
    path = str(tmp_path / "profile")
    days = {
        "d1": spark.range(20_000).selectExpr("id % 9000 AS k", "concat('t', id % 50) AS name", "if(id % 4 = 0, null, double(id)) AS v", "array(id % 7) AS a"),
        "d2": spark.range(10_000).selectExpr("id + 5000 AS k", "cast(null AS string) AS name", "double('nan') AS v", "array(id % 3) AS a"),
    }
    for day, frame in days.items():
        profiles.write_part(frame, path, day)
    profiles.write_part(days["d2"], path, "d2")  # writing a part again replaces it
    got = {r["column"]: r for r in rows(profiles.merged_profile(profiles.read_parts(spark, path)))}
    whole = days["d1"].unionByName(days["d2"])
    for r in rows(quality.profile_columns(whole)):
        mine = got[r["column"]]
        assert [mine[c] for c in ("row_count", "null_count", "non_null", "is_numeric")] == [r[c] for c in ("row_count", "null_count", "non_null", "is_numeric")]
        assert abs(mine["distinct_count"] - r["distinct_count"]) <= 4 * profiles.theta_error() * r["distinct_count"] + 1
    assert got["name"]["quantiles"] is None and abs(got["v"]["quantiles"][1] - 10_000) < 600
    once = profiles.write_parts(whole.withColumn("part_", F.lit("d1")), str(tmp_path / "once"), "part_", ["k"])
    assert once is None and profiles.read_parts(spark, str(tmp_path / "once")).count() == 1


def test_repeated_texts_and_what_is_shuffled(spark):
    """Exact counts of repeated texts; texts that occur once stay where they are."""
    frame = spark.range(3000).selectExpr("if(id % 100 = 0, 'same', concat(repeat('long text ', 50), id)) AS a", "if(id % 3 = 0, null, concat('v', id div 6)) AS b")
    got = {(r["column"], r["value"]): r["n"] for r in rows(quality.repeated_texts(frame, ["a", "b"]))}
    assert got.pop(("a", "same")) == 30 and set(got.values()) == {4} and len(got) == 500
    rules = [QualityRule("a", "unique", "a"), QualityRule("b", "unique", "b"), QualityRule("n", "not_null", "b")]
    result = {r["rule_id"]: (r["records_failed"], r["sample_failures"][:2]) for r in rows(quality.evaluate_rules(frame, rules))}
    assert result == {"a": (30, ["same", "same"]), "b": (2000, ["v0", "v0"]), "n": (1000, [None, None])}
    once = spark.range(50).selectExpr("concat('only ', id) AS a")
    assert quality.repeated_texts(once, ["a"]).count() == 0
    assert rows(quality.evaluate_rules(once, rules[:1]))[0]["status"] == "passed"


def test_profile_of_every_kind_of_column(spark):
    frame = spark.createDataFrame([(1, "x", [1.0], True, None), (2, "x", [1.0], None, None), (2, None, None, False, None)],
                                  "`a.b` int, t string, v array<float>, f boolean, n string")
    got = {r["column"]: (r["row_count"], r["null_count"], r["distinct_count"]) for r in rows(quality.profile_columns(frame))}
    assert got == {"a.b": (3, 0, 2), "t": (3, 1, 1), "v": (3, 1, 1), "f": (3, 1, 2), "n": (3, 3, 0)}
