"""Every registered query against DuckDB on the smallest test tables."""

import pytest

from compare import differences, duck
from tablegauge.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    found = differences(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])
    assert [d for d in found if d != "EMPTY"] == []
