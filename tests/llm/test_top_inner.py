import numpy as np
from llm_help import rows
from pyspark.sql import functions as F

from tallyward.llm import top_inner


def brute(vectors, k):
    ids = sorted(vectors)
    whole = {i: [int(np.floor(1024 * x)) for x in vectors[i]] for i in ids}
    out = {}
    for q in (i for i in ids if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in ids if c != q)
        out[q] = [(c, -s) for s, c in scores[:k]]
    return out


def search(frame, k=10):
    vectors = top_inner.integer_vectors(frame)
    found = rows(top_inner.top_inner(vectors, vectors.where(F.col("vec_id") % 100 == 0), k), "query_id")
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_against_brute_force(spark, monkeypatch):
    for name, value in (("CANDIDATES_PER_BLOCK", 300), ("QUERIES_PER_BLOCK", 4), ("SEEDS", 40), ("CHUNK", 64), ("QUERY_CHUNK", 3)):
        monkeypatch.setattr(top_inner, name, value)
    gen = np.random.default_rng(5)
    vectors = {i: (gen.normal(size=12) * gen.exponential(1.0)).tolist() for i in range(1500)}
    for i in range(0, 300, 7):
        vectors[i + 1] = vectors[i]  # ties
    frame = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<double>").repartition(5)
    assert search(frame) == brute(vectors, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(None, [1.0, 2.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (0, [1.0, -0.5]), (0, [1.0, -0.5]), (7, [0.25, 0.1]), (8, [0.25, 0.1]), (9, [0.0, 0.0]), (100, [1.0])]
    frame = spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<double>, score int")
    got = search(frame)
    assert set(got) == {0} and [c for c, _ in got[0]] == [7, 8, 9]
    assert search(frame.limit(0)) == {}
