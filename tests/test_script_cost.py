"""What the scans of script text cost: each step once per statement, over all cores."""

import pytest

from tallyward.operators import column_refs, scripts
from tallyward.plans import lineage as plans


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    rows = [(i, f"big bolt {i}", "Brand#1", "TIN", i % 5) for i in range(40)]
    frame = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    frame.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_column_references_fold_the_brackets_of_a_statement_once(spark):
    texts = spark.createDataFrame([("a.sql", "insert into t select a from s")], "path string, sql string")
    plan = optimized(column_refs.column_refs_in_sql(texts))
    assert plan.count(column_refs._SELECT_BLOCK) == 2  # its blocks, and what is around them
    assert plan.count(column_refs._COMMON) == 3  # name, columns and block


def test_statements_read_their_target_once(spark):
    texts = spark.createDataFrame([("a.sql", "insert into t select a from s")], "path string, sql string")
    assert optimized(scripts.statements_in_sql(texts)).count(scripts._TARGET) == 1


def test_embedded_statements_do_not_look_for_datasets(spark):
    frame = spark.createDataFrame([("a.py", "x")], "path string, content string")
    assert scripts._CHAIN not in optimized(scripts.embedded_sql(frame))


def test_call_chains_are_found_once_for_reads_and_writes(spark):
    frame = spark.createDataFrame([("a.py", "x")], "path string, content string")
    assert optimized(scripts.script_dataset_literals(frame)).count(scripts._CHAIN) == 1


@pytest.mark.parametrize("corpus", ["_sql_scripts", "_python_scripts", "_edge_scripts", "_column_scripts"])
def test_scripts_of_one_small_file_use_all_cores(spark, parts, corpus):
    frame = getattr(plans, corpus)(spark, parts)
    assert frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert frame.count() == 40
