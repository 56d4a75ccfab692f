import math
from dataclasses import replace

from conftest import rows
from pyspark.sql import functions as F

from tallyward.operators import explain
from tallyward.operators.quality import QualityRule
from tallyward.streaming.quality import stream_quality
from tallyward.streaming.runs import run_available


def test_importance(spark):
    df = spark.range(60).selectExpr("cast(id as double) AS income", "cast(id % 30 as double) AS debt",
                                    "cast(3 * id % 50 as double) AS credit", "int(id - id % 30 > 20) AS label", "'x' AS note")
    surrogate = explain.fit_surrogate(df, "label")
    assert surrogate.features == ("income", "debt", "credit")
    got = explain.global_importance(surrogate).collect()
    assert got[0]["feature"] == "income" and abs(sum(r["importance"] for r in got) - 1) < 1e-3
    assert all(r["importance"] >= 0 for r in got) and len(got) == 3
    local = rows(explain.local_explanation(surrogate, 999))
    assert {r["feature"] for r in local} == {"income", "debt", "credit"} and {r["instance_index"] for r in local} == {59}
    stored = rows(explain.stored_importance(explain.global_importance(surrogate), "v", "2024-01-01"))
    assert {r["version_id"] for r in stored} == {"v"}


def test_shapley_values_are_those_of_all_coalitions(spark):
    """Each row's attributions against the definition: every coalition scored, features outside it at the mean row."""
    df = spark.range(80).selectExpr("cast(id % 7 as double) AS a", "cast(id % 11 as double) AS b", "cast(id * 3 % 13 as double) AS c",
                                    "cast(id as double) AS d", "int(id % 7 + id % 11 > 8) + int(id > 60) AS label")
    surrogate = explain.fit_surrogate(df, "label", 4)
    data = [tuple(r) for r in surrogate.rows.limit(4).collect()]
    mean = tuple(surrogate.rows.agg(*[F.avg(c) for c in surrogate.features]).first())
    n = len(mean)
    mixes = [(k, code, *(x[i] if code >> i & 1 else mean[i] for i in range(n))) for k, x in enumerate(data) for code in range(1 << n)]
    scored = surrogate.score(spark.createDataFrame(mixes, f"k int, code int, {', '.join(f'{c} double' for c in surrogate.features)}"))
    value = {(r["k"], r["code"]): r["p"] for r in scored.collect()}
    got = explain.shapley_values(spark_rows(surrogate, data, spark)).collect()
    for k in range(len(data)):
        for i in range(n):
            share = 0.0
            for cls in surrogate.explained_classes():
                total = 0.0
                for code in range(1 << n):
                    if not code >> i & 1:
                        size = bin(code).count("1")
                        weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                        total += weight * (value[k, code | 1 << i][cls] - value[k, code][cls])
                share += abs(total) / len(surrogate.explained_classes())
            assert abs(got[k][f"a{i}"] - share) < 1e-9


def spark_rows(surrogate, data, spark):
    frame = spark.createDataFrame(data, ", ".join(f"{c} double" for c in surrogate.features)).coalesce(1)
    return replace(surrogate, rows=frame, means=tuple(surrogate.rows.agg(*[F.avg(c) for c in surrogate.features]).first()))


def test_stream_quality_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(48).selectExpr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) AS ts",
                               "if(id % 6 = 0, null, id) AS v").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp_ntz, v bigint").parquet(source)
    out = run_available(spark, stream_quality(stream, [QualityRule("v", "not_null", "v")], "ts", "12 hours"), "t")
    got = rows(out, "window_start")
    assert [(r["records_evaluated"], r["records_failed"], r["status"]) for r in got] == [(12, 2, "failed")] * 3
