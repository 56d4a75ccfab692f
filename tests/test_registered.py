"""Registered queries against their SQL on the smallest tables; ORACLE_ALL=1 runs every one."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

QUICK = ("quality_run", "profile_columns", "max_sensitivity", "pick_entity", "resolve_refs", "impact",
         "openlineage_edges", "drift_check", "dataset_drift", "bias_test", "facets", "upsert_assets", "risk_score",
         "etl_customer_360")
NAMES = list(entry.queries()) if os.environ.get("ORACLE_ALL") else QUICK


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, db, small, name):
    assert compare(spark, db, small, name) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 4
