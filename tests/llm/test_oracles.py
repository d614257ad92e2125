"""Queries with SQL against it."""

import pytest

from parlance.llm import catalog

from ..oracle import connect, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(llm, name):
    df = catalog.queries()[name](llm, FOLDER)
    cursor = connect(FOLDER).execute(catalog.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
