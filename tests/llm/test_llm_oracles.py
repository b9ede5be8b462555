"""Queries with SQL beside it, as the driver runs them."""

import oracle
import pytest
from lexgrove.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert not oracle.differences(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
