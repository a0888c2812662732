"""Every deterministic registered query equals its DuckDB oracle (small scale factor)."""

import pytest

from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def _names():
    import __spark_entry__ as entry
    return sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as entry
    status, msg = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status == "OK", msg


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert "total_records" in df.columns
