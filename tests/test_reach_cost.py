"""What a walk from many starts moves: ends of the graph do not go on."""

from conftest import rows

from tallyward.operators import graph


def test_ends_of_the_graph_start_no_round(spark, monkeypatch):
    labels = []
    write = graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: labels.append(label) or write(df, label))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("e", "d")], "source_id string, target_id string")
    got = {(r["start"], r["id"], r["depth"]) for r in rows(graph.reach(edges))}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "b", 0), ("b", "c", 1), ("b", "d", 1), ("e", "e", 0), ("e", "d", 1)}
    assert labels.count("arrivals") == 3  # the starts and two rounds, none for c and d alone


def test_a_given_start_without_edges_and_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), (None, "c")], "source_id string, target_id string")
    starts = spark.createDataFrame([("a",), ("c",)], "id string")
    got = {(r["start"], r["id"], r["depth"]) for r in rows(graph.reach(edges, starts))}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("c", "c", 0)}
