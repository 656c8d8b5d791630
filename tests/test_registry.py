"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle_check import compare, connect

from tickloom.plans import registry

NAMES = list(registry.queries())
SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        assert compare(got, connect(SF).execute(sql).df()) == ""
