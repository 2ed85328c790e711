import pytest

import __spark_entry__ as contract
from tests.oracle_check import assert_same


# Subpackages test their own queries in their own folders.
OWN = [name for name in sorted(contract.oracle_sql()) if name.startswith("plumbing")]


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", OWN)
def test_matches_oracle(spark, name, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    df = contract.queries()[name](spark, sf_dir)
    assert assert_same(df, sf_dir, contract.oracle_sql()[name]) > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.dtypes == [("n_name", "string"), ("revenue", "double")]
    assert df.count() > 0
