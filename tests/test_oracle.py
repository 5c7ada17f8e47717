"""Every registered query against its DuckDB SQL on the sf0.001 tables
(the driver runs the same check at sf0.01; ``tests/oracle_check.py``)."""

import pytest

from coordspark.plans.queries import QUERIES, SQL
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    msg, ok = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok, msg
