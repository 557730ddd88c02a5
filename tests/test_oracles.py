"""Every ★ query against its DuckDB oracle on the smallest data set."""

import pytest

from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def _names():
    from breachlens.oracle_sql import ORACLES
    return sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    r = compare(spark, con, name, queries()[name], oracle_sql()[name], SF)
    assert r["cols_ok"] and r["spark_rows"] == r["duck_rows"] and r["values_ok"], r


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0 and "risk_band" in df.columns
