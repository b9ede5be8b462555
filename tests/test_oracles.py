"""Every registered query beside its SQL; those without SQL give rows and the same schema twice."""

import oracle
import pytest
import lexgrove.plans  # noqa: F401  (registers the queries)
from lexgrove.plans.shared import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert not oracle.differences(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_without_the_subpackage(spark, monkeypatch):
    """The rest works where llm and the pipeline are gone."""
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "_llm", lambda: None)
    assert set(__spark_entry__.queries()) == set(QUERIES) and __spark_entry__.oracle_sql() == ORACLES
    assert __spark_entry__.entry(spark).count() > 0
