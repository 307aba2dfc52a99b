"""Every registered query against its DuckDB oracle on the smallest scale
(the driver's gate, run at sf0.01, uses the same comparison)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, E.queries()[key], E.oracle_sql().get(key), SF)
    assert r.get("ok") is not False, r.get("problems")


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "model" and df.count() >= 0
