"""Every registered query against its oracle SQL, all rows and values."""

import pytest
from compare import compare, connect
from conftest import SF_DIR

import __spark_entry__ as contract
from millrace.plans import ORACLES, QUERIES

ROWS_ONLY = {"distinct_users_sketch", "storage_usage", "vector_ann"}


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_equals_oracle(spark, oracle, key):
    assert compare(spark, oracle, key, SF_DIR) is None


def test_only_inexact_queries_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert df.columns == ["day", "rg_name", "n_queries", "n_scan_rows", "n_mem", "n_cpu"]
