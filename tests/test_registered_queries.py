"""Every registered query against its SQL counterpart."""

import pytest

from compare import check, connect
from foliotab.plans import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    note, _, ok = check(spark, duck, name, QUERIES[name], ORACLES.get(name), sf)
    assert ok, note
