"""Every registered query against its SQL oracle, on the smallest tables."""

import pytest

from parlance.catalog import oracle_sql, queries

from .oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, name, FOLDER) is None


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
